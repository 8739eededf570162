"""SentencePiece merge-type (BPE) encoding and decoding by backtracking.

The result of merging is found without running the merges. An Aho-Corasick
automaton of the reversed pieces, run over the reversed text, tells the longest piece that starts at each place; all others that start
there are pieces that this one begins with. The encoder takes the
longest piece that is compatible with the piece before it, and steps back when
none fits; a bitfield marks places from which the rest is known to fail. Two
neighbours are compatible when merging their joined characters again yields
the same two pieces; a text's encoding is the one sequence whose neighbours
are all compatible.

Texts are cut where no piece can cross (before a run of the space mark, and
around characters that no piece holds). Rows are taken about ``CHUNK`` bytes at a time; the distinct words of a chunk are
matched and searched side by side, each step a few array operations over all words that aren't done. Words of over ``WIDE``
characters, and the last ``FEW`` of a chunk, are searched one by one.

Texts of over ``LONG`` characters are encoded, joined and decoded some words at a time. A run of over ``FRAME``
characters without a cut is searched with the matches of a few frames at a time, and what is kept of it is a bit for each
character and some packed numbers for each piece, so one run of 50 MB fits a task.

Defined results: null texts are empty and give no ids; characters outside the
vocabulary give their UTF-8 bytes as byte pieces; control strings in a text are
ordinary characters; repeated rows are encoded alike; texts of any length are encoded whole; an empty table gives an
empty table; other columns, whatever their names, are kept by ``encode_documents`` unless they clash with its output
columns, which replace them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, give_back, row_chunks, text_bytes

SPACE = "▁"
MARK = ord(SPACE)
CACHE_PAIRS, PAIR_BITS = 400_000, 21
LONG, FRAME, FRAMES, PART = 1 << 18, 1 << 14, 4, 1 << 16
CHUNK, WIDE, FEW = 1 << 18, 256, 24
ODD = np.uint64(0x9E3779B97F4A7C15)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def lookup(keys: np.ndarray, values: np.ndarray):
    """A function from arrays of keys to their values, -1 for others: one table with open slots."""
    bits = max(4, (4 * len(keys)).bit_length())
    shift, last = np.uint64(64 - bits), (1 << bits) - 1
    held, given = np.full(last + 1, -1, np.int64), np.full(last + 1, -1, np.int32)

    def slot(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * ODD >> shift).view(np.int64)

    at, left = slot(keys), np.arange(len(keys))
    while len(left):
        free = left[held[at[left]] < 0]
        held[at[free]] = keys[free]
        left = left[held[at[left]] != keys[left]]
        at[left] = at[left] + 1 & last
    given[at] = values

    def get(x: np.ndarray) -> np.ndarray:
        at = slot(x)
        found = held[at]
        out = np.where(found == x, given[at], -1)
        left = np.flatnonzero((found != x) & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & last
            found = held[at[left]]
            hit = found == x[left]
            out[left[hit]] = given[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    return get


class PieceModel:
    """Vocabulary, merge order and the backtracking encoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {t: i for i, t in self.text.items()}
        self.rank = {i: -sp.get_score(i) for i in plain}
        byte_ids = [i for i in range(size) if sp.is_byte(i)]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in byte_ids}
        if len(self.byte_id) != 256:
            raise ValueError("the model must have the 256 byte pieces")
        if sp.encode(" a  b") != sp.encode(" a  b ")[: len(sp.encode(" a  b"))] or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("only models without text normalisation are supported")
        self.chars = {c for t in self.ids for c in t}
        if not self.chars <= self.ids.keys():
            raise ValueError("each character of a piece must be a piece")
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            raise ValueError("pieces may hold the space mark only at their start")
        self.bytes = [b""] * size
        for i, t in self.text.items():
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.size = size
        self.shown_of = pa.array([b"%d," % i for i in range(size)], pa.binary())
        self.bytes_of = pa.array(self.bytes, pa.binary())
        self._spines()
        self.longest = max(map(len, self.ids))
        self.finder = ahocorasick.Automaton()
        for i in self.reached:
            self.finder.add_word(self.text[i][::-1], i)
        self.finder.make_automaton()
        #: (length, piece) of the reachable pieces that a piece begins with, the longest first.
        self.starts = {i: [(n, j) for n in range(len(t), 0, -1) if (j := self.ids.get(t[:n])) in self.reached] for i in self.reached for t in (self.text[i],)}
        outside = "".join(re.escape(c) for c in "\n\t\r" if c not in self.chars)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{outside}]+|{SPACE}+|[{outside}]" if outside else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.held = 0
        self._tables()

    def _tables(self) -> None:
        """The automaton, the options and the pairs met lately as arrays."""
        self.inside = np.zeros(0x110000, bool)
        self.inside[[ord(c) for c in self.chars]] = True
        nodes = {"": 0}
        for i in self.reached:
            t = self.text[i][::-1]
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        #: Of each node: the one of its longest proper end, and the longest piece that it ends with.
        self.fail, self.found = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int32)
        for p, k in sorted(nodes.items(), key=lambda x: len(x[0])):
            if p:
                self.fail[k] = next(nodes[p[n:]] for n in range(1, len(p) + 1) if p[n:] in nodes)
                i = self.ids.get(p[::-1])
                self.found[k] = i if i in self.reached else self.found[self.fail[k]]
        edges = [(nodes[p[:-1]] << 21 | ord(p[-1]), k) for p, k in nodes.items() if p]
        self.edge = lookup(np.array([x for x, _ in edges], np.int64), np.array([k for _, k in edges], np.int32))
        counts = np.array([len(self.starts.get(i, ())) for i in range(self.size)], np.int64)
        self.option_at = np.concatenate([[0], np.cumsum(counts)])
        options = [x for i in range(self.size) for x in self.starts.get(i, ())] + [(0, 0)]
        self.option_size, self.option_id = np.array(options, np.int64).T.copy()
        self.pair_key, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.weights = np.random.default_rng().integers(0, 1 << 64, WIDE, np.uint64)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges by rank, leftmost first, on a few characters; also the parts of the last merge."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        todo: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts) and (i := self.ids.get(t := parts[left] + parts[right])) is not None:
                heapq.heappush(todo, (self.rank[i], left, right, t))

        for k in range(len(parts)):
            offer(k)
        last = None
        while todo:
            _, left, right, t = heapq.heappop(todo)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != t:
                continue
            last = (parts[left], parts[right])
            parts[left], parts[right] = t, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p is not None], last

    def _spines(self) -> None:
        """Each reachable piece's outer parts, from the piece inward, with the rank that uses each up."""
        made: dict[int, tuple[int, int]] = {}
        self.reached, self.odd = set(), set()
        for i, t in self.text.items():
            got, last = self.merge(t)
            if got != [t]:
                continue
            self.reached.add(i)
            if last:
                a, b = made[i] = self.ids[last[0]], self.ids[last[1]]
                if len(last[0]) > 1 and self.rank[a] >= self.rank[i] or len(last[1]) > 1 and self.rank[b] >= self.rank[i]:
                    self.odd.add(i)
        #: Pieces of which a part has no better rank: merging them again in full decides.
        for i in sorted(made, key=lambda i: len(self.text[i])):
            if self.odd & {*made[i]}:
                self.odd.add(i)
        first = float("-inf")  # single characters are there from the start
        self.right: dict[int, list[tuple[str, float, float]]] = {}
        self.left: dict[int, list[tuple[str, float, float]]] = {}
        for spine, side in ((self.right, 1), (self.left, 0)):
            for i in self.reached:
                at, used, out = i, float("inf"), []
                while True:
                    born = self.rank[at] if at in made else first
                    out.append((self.text[at], born, used))
                    if at not in made:
                        break
                    used, at = self.rank[at], made[at][side]
                spine[i] = out

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b again gives a and b."""
        if a in self.odd or b in self.odd:
            return self.merge(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        for x, born_x, used_x in self.right[a]:
            for y, born_y, used_y in self.left[b]:
                got = self.ids.get(x + y)
                # Across the seam x and y would merge once both exist, before either is used up; at equal rank the left one goes first.
                if got is not None and (when := max(self.rank[got], born_x, born_y)) < used_x and when <= used_y and not born_y >= used_x and not born_x > used_y:
                    return False
        return True

    def _longest(self, text: str) -> dict[int, int]:
        """The longest piece that starts at each place, places counted from the end of the text."""
        return dict(reversed(list(self.finder.iter(text[::-1]))))  # of one place the longest comes first

    def _known(self, text: str) -> list[int]:
        """Encoding of characters that all are pieces."""
        n, pairs, starts, longest = len(text), self.pairs, self.starts, self._longest(text)
        failed = 0  # bits of places that no encoding of the rest follows, given any piece before it that was tried
        pieces: list[int] = []
        left = []  # of each piece: the options that weren't tried, its place, and what is known of its left neighbour
        here, known, options = 0, None, iter(starts[longest[n - 1]])
        while True:
            for size, i in options:
                end = here + size
                if failed >> end & 1:
                    continue
                if known is not None:
                    ok = known.get(i)
                    if not (self._pair(pieces[-1], i) if ok is None else ok):
                        continue
                pieces.append(i)
                if end == n:
                    return pieces
                left.append((options, here, known))
                here, known, options = end, pairs[i], iter(starts[longest[n - 1 - end]])
                break
            else:
                if not pieces:
                    raise ValueError("no encoding found")
                failed |= 1 << here
                pieces.pop()
                options, here, known = left.pop()

    def _framed(self, text: str) -> array:
        """``_known`` for a long run: longest pieces of a few frames at a time, packed numbers for what is chosen."""
        n, frames = len(text), {}

        def options(here: int) -> list[tuple[int, int]]:
            f = here // FRAME
            if f not in frames:
                part = text[f * FRAME : (f + 1) * FRAME + self.longest]
                frames[f] = len(part) - 1 + f * FRAME, self._longest(part)
                if len(frames) > FRAMES:
                    del frames[next(iter(frames))]
            last, longest = frames[f]
            return self.starts[longest[last - here]]

        failed = bytearray((n >> 3) + 1)
        pieces, choice, place = array("i"), array("h"), array("q")
        here, k = 0, 0
        while True:
            tried = options(here)
            while k < len(tried):
                size, i = tried[k]
                k += 1
                end = here + size
                if failed[end >> 3] >> (end & 7) & 1 or pieces and not self._pair(pieces[-1], i):
                    continue
                pieces.append(i)
                if end == n:
                    return pieces
                place.append(here)
                choice.append(k)
                here, k = end, 0
                break
            else:
                if not pieces:
                    raise ValueError("no encoding found")
                failed[here >> 3] |= 1 << (here & 7)
                pieces.pop()
                here, k = place.pop(), choice.pop()

    def _pair(self, before: int, i: int) -> bool:
        ok = self.pairs[before].get(i)
        if ok is None:
            if self.held >= CACHE_PAIRS:
                for x in self.pairs.values():
                    x.clear()
                self.held = 0
            self.held += 1
            ok = self.pairs[before][i] = self.fits(before, i)
        return ok

    def _word(self, text: str) -> array:
        known = self._known if len(text) <= FRAME else self._framed
        if self.chars.issuperset(text):
            return array("i", known(text))
        out, run = array("i"), 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > run:
                    out.extend(known(text[run:k]))
                out.extend([self.byte_id[b] for b in c.encode()])
                run = k + 1
        if run < len(text):
            out.extend(known(text[run:]))
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs."""
        key = a.astype(np.int64) * self.size + b
        at = (key.view(np.uint64) * ODD >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        ok = self.pair_fits[at]
        miss = np.flatnonzero(self.pair_key[at] != key)
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            ok[miss] = np.array([self._pair(*divmod(x, self.size)) for x in new.tolist()], bool)[which]
            self.pair_key[at[miss]] = key[miss]
            miss = miss[self.pair_key[at[miss]] == key[miss]]  # of two pairs in one slot one stays
            self.pair_fits[at[miss]] = ok[miss]
        return ok

    def _longest_of_all(self, codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``_longest`` of many words, the longest words first; places counted from the start of ``codes``."""
        longest, state = np.zeros(len(codes), np.int32), np.zeros(len(ends), np.int64)
        more = np.searchsorted(-sizes, -np.arange(sizes[0]))  # words of more than 0, 1, ... characters
        for k, n in enumerate(more.tolist()):
            at = ends[:n] - 1 - k
            state = state[:n]
            c = codes[at].astype(np.int64)
            to = self.edge(state << 21 | c).astype(np.int64)
            left = np.flatnonzero(to < 0)
            while len(left):  # each character is a piece, so the first node has an edge for it
                state[left] = self.fail[state[left]]
                to[left] = self.edge(state[left] << 21 | c[left])
                left = left[to[left] < 0]
            state = to
            longest[at] = self.found[state]
        return longest

    def _search(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_known`` of many words, the longest first: numbers of pieces, and pieces, kept from each word's start on."""
        counts, piece = np.zeros(len(starts), np.int64), np.zeros(len(codes), np.int32)
        word, start, end = np.arange(len(starts)), starts, starts + sizes
        if len(word) > FEW:
            longest = np.append(self._longest_of_all(codes, end, sizes), 0)
            failed = np.zeros(len(codes) + self.longest + 1, bool)  # a word's start never fails, so words don't mix
            place, choice = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            here, top, k = start.copy(), start.copy(), np.zeros(len(word), np.int64)
        while len(word) > FEW:
            first = longest[here]
            tried = self.option_at[first] + k
            more = tried < self.option_at[first + 1]
            i, to = self.option_id[tried], here + self.option_size[tried]
            go = more & ~failed[to]
            inner = np.flatnonzero(go & (top > start))
            go[inner] = self._fit(piece[top[inner] - 1], i[inner])
            back, go = np.flatnonzero(~more), np.flatnonzero(go)
            k += 1
            at = top[go]
            piece[at], place[at], choice[at] = i[go], here[go], k[go]
            here[go], k[go] = to[go], 0
            top[go] += 1
            if len(back):
                if (top[back] == start[back]).any():
                    raise ValueError("no encoding found")
                failed[here[back]] = True
                top[back] -= 1
                here[back], k[back] = place[top[back]], choice[top[back]]
            done = here == end
            counts[word[done]] = (top - start)[done]
            word, start, end, here, top, k = (x[~done] for x in (word, start, end, here, top, k))
        for w, a, b in zip(word.tolist(), start.tolist(), end.tolist()):
            got = self._known(as_text(codes[a:b]))
            piece[a : a + len(got)] = got
            counts[w] = len(got)
        return counts, piece

    def _ids(self, codes: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked texts, given as characters and where each begins, and where each text's ids begin."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(text_at), np.int64)
        mark, begin = codes == MARK, ~self.inside[codes]
        begin[1:] |= ~self.inside[codes[:-1]] | mark[1:] & ~mark[:-1]
        begin[text_at[text_at < n]] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(starts, append=n)
        # Each word's first like: by hash, then by its characters.
        within = np.arange(n) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(codes * self.weights[np.minimum(within, WIDE - 1)], starts)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[which]
        other = codes[np.minimum(np.repeat(starts[like], sizes) + within, n - 1)] != codes
        other = np.flatnonzero(np.logical_or.reduceat(other, starts) | (sizes != sizes[like]))
        which[other] = len(first) + np.arange(len(other))
        first = np.concatenate([first, other])
        order = np.argsort(-sizes[first], kind="stable")
        first, rank = first[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]

        fast = self.inside[codes[starts[first]]] & (sizes[first] <= WIDE)
        counts, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        size = sizes[first[fast]]
        held = np.cumsum(size) - size
        counts[fast], flat = self._search(codes[spans(starts[first[fast]], size)], held, size)
        at[fast] = held
        slow = [np.frombuffer(self._word(as_text(codes[a:b])), np.int32) for a, b in zip(starts[first[~fast]].tolist(), (starts + sizes)[first[~fast]].tolist())]
        counts[~fast] = [len(x) for x in slow]
        at[~fast] = len(flat) + np.cumsum(counts[~fast]) - counts[~fast]
        flat = np.concatenate([flat, *slow])
        size = counts[which]
        return flat[spans(at[which], size)], np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, text_at)]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after another, and where those of each begin, with the end."""
        sizes = [len(t) + 1 if t else 0 for t in texts]
        return self._ids(characters("".join([SPACE + t for t in texts if t])), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))

    def written(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, memoryview]]:
        """The ids as text, each with a comma after it, and their bytes; each with where every id's begins."""
        for pieces in (self.shown_of, self.bytes_of):
            got = pieces.take(pa.array(ids))
            yield np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1], memoryview(got.buffers()[2] or b"")

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, in one part or, if it is long, in many."""
        if not text:
            return
        if len(text) <= LONG:
            yield self.batch([text])[0]
            return
        marked = SPACE + text.replace(" ", SPACE)
        held, size = [], 0
        for m in self.cut.finditer(marked):
            a, b = m.span()
            if held and size + b - a > PART:
                yield self._ids(characters("".join(held)), np.zeros(1, np.int64))[0]
                held, size = [], 0
            if b - a > PART:
                ids = np.frombuffer(self._word(marked[a:b]), np.int32)
                for k in range(0, len(ids), PART):
                    yield ids[k : k + PART]
            else:
                held.append(marked[a:b])
                size += b - a
        if held:
            yield self._ids(characters("".join(held)), np.zeros(1, np.int64))[0]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.parts(text) for i in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space put before it."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def digested(self, text: str) -> tuple[np.ndarray, str, str]:
        """Ids, and digests of the ids joined by commas and of the decoded text; a part at a time."""
        packed, of_ids, of_text = [], hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            (_, shown), (_, out) = self.written(ids)
            if packed:
                of_ids.update(b",")
            elif out[:1] == b" ":
                out = out[1:]
            packed.append(ids)
            of_ids.update(shown[:-1])
            of_text.update(out)
        return np.concatenate([np.zeros(0, np.int32), *packed]), of_ids.hexdigest(), of_text.hexdigest()

    def digested_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """``batch``, and both digests of each text."""
        if len(texts) == 1 and len(texts[0]) > LONG:
            ids, of_ids, of_text = self.digested(texts[0])
            return ids, np.array([0, len(ids)]), [of_ids], [of_text]
        ids, at = self.batch(texts)
        (shown_at, shown), (out_at, out) = self.written(ids)
        of_ids = [hashlib.sha256(shown[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(shown_at[at].tolist())]
        of_text = [hashlib.sha256(out[a + (out[a : a + 1] == b" " and a < b) : b]).hexdigest() for a, b in pairwise(out_at[at].tolist())]
        return ids, at, of_ids, of_text


def characters(text: str) -> np.ndarray:
    """A text's characters as numbers, with marks for its spaces."""
    return np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), np.uint32)


def as_text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


OUTPUT = [("n_tokens", T.LongType()), ("token_ids", T.ArrayType(T.IntegerType())), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, token_ids, ids_sha256 (decimal ids joined by commas) and decoded_sha256 to each row.

    No shuffle: each row is encoded where it is read. ``with_ids`` False leaves out token_ids, and the text column goes with it.
    """
    outputs = [(n, t) for n, t in OUTPUT if with_ids or n != "token_ids"]
    names = {n for n, _ in outputs}
    keep = [c for c in docs.columns if c not in names and (with_ids or c != text)]
    source = docs.select(col(text).alias("text"), F.struct(F.lit(0), *[col(c).alias(str(k)) for k, c in enumerate(keep)]).alias("row"))
    made = [T.StructField(n, t) for n, t in outputs]
    schema = T.StructType([source.schema["row"], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for lo, hi in row_chunks(text_bytes(whole.column(0))[1], CHUNK):
                batch = whole.slice(lo, hi - lo)
                ids, at, of_ids, of_text = m.digested_batch([x or "" for x in batch.column(0).to_pylist()])
                made = {"n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
                if with_ids:
                    made["token_ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(1), *[made[n] for n, _ in outputs]], names=["row", *[n for n, _ in outputs]])
        give_back()

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col("row").getField(str(k)).alias(c) for k, c in enumerate(keep)], *[n for n, _ in outputs])
