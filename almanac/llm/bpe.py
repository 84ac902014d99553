"""Byte-level BPE encoding and decoding with a transducer lexicon.

The corpus' frequent words are encoded once and compiled into a minimal acyclic automaton whose arcs are bytes and whose
outputs are token ids: words that end alike share their suffix states. The compiled tables are one block of bytes of
bounded size; every Python worker maps it into memory and looks words up there. A word that the lexicon lacks is merged
exactly, by rank. Encoding is the tokenizers library's, text for text, and decoding is its decode().
"""

from __future__ import annotations

import gc
import heapq
import json
import mmap
import struct
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import pick, scratch

#: The lexicon holds at most so many words, so what is broadcast is bounded at about LEXICON_WORDS * 60 bytes.
LEXICON_WORDS = 50_000
#: Words longer than this are merged, not kept in the lexicon or a cache.
LONG_WORD = 64
#: Distinct pieces of text, and words, that a Python worker remembers before a new batch: with more it starts anew.
CACHE_WORDS = 200_000

# Fixed value: the byte-level vocabulary's word pattern, with Unicode's white space spelt out.
_SPACE = r"\p{White_Space}"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!(?:[^{_SPACE}]))|{_SPACE}+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BITS = 24
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62


class Vocabulary:
    """Merges and pieces of a tokenizers file of a byte-level BPE."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        byte_of = {c: b for b, c in byte_letters().items()}
        ids = model["vocab"]
        self.ids = {bytes(byte_of[c] for c in piece): i for piece, i in ids.items() if all(c in byte_of for c in piece)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a pair of ids as one number to its rank and what it becomes as one number
        self.merges = {ids[a] << _BITS | ids[b]: rank << _BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [ids[byte_letters()[b]] for b in range(256)]
        known = sorted(self.merges.items()) or [(-1, _NONE)]
        self._pairs, self._becomes = (np.array(x, np.int64) for x in zip(*known, strict=True))
        self._firsts = np.array(self.first, np.int64)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.pieces |= {i: c.encode() for c, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the leftmost pair of lowest rank merges until no pair is in the list. Short words keep
        their pairs in a list; long ones in a heap over a linked list, so n bytes take n log n steps."""
        return self._merge_short(word) if len(word) <= LONG_WORD else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        get, first = self.merges.get, self.first
        ids = [first[b] for b in word]
        pairs = [get(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i, new = pairs.index(best), best & _MASK
            ids[i] = new
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(new << _BITS | ids[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(ids[i - 1] << _BITS | new, _NONE)
        return ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many short words: words of one length are the rows of a matrix, and in each round every row that has
        a pair to merge merges its leftmost of lowest rank."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            ids = self._firsts[np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8)].reshape(len(rows), size)
            pairs = self._look(ids[:, :-1], ids[:, 1:])
            while len(rows):
                n = ids.shape[1]
                at = pairs.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
                best = pairs[np.arange(len(rows)), at] if n > 1 else np.full(len(rows), _NONE)
                done = best == _NONE
                for k, whole in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = whole
                rows, ids, pairs, at, best = rows[~done], ids[~done], pairs[~done], at[~done], best[~done]
                if not len(rows):
                    break
                each, here = np.arange(len(rows)), at[:, None]
                ids[each, at] = best & _MASK
                ids = np.take_along_axis(ids, np.arange(n - 1) + (np.arange(n - 1) > here), axis=1)
                pairs = np.take_along_axis(pairs, np.arange(n - 2) + (np.arange(n - 2) > here), axis=1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
                pairs[left, at[left] - 1] = self._look(ids[left, at[left] - 1], ids[left, at[left]])
                pairs[right, at[right]] = self._look(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of pairs of ids, _NONE if they don't merge."""
        key = a << _BITS | b
        k = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[k] == key, self._becomes[k], _NONE)

    def _merge_long(self, word: bytes) -> list[int]:
        get = self.merges.get
        ids = [self.first[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << _BITS | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & _MASK, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if (p := before[i]) >= 0 and (m := get(ids[p] << _BITS | ids[i])):
                heapq.heappush(heap, (m, p, ids[p], ids[i]))
            if k < n and (m := get(ids[i] << _BITS | ids[k])):
                heapq.heappush(heap, (m, i, ids[i], ids[k]))
        return [x for x in ids if x >= 0]


# ---------------------------------------------------------------- the lexicon


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer of sorted entries (word, ids), as bytes: states' arc ranges, arcs (byte, target,
    output), outputs. An arc's output is what its word's ids have beyond what other words through the arc share; equal
    suffix states are one."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[0], node[1], tuple((b, t, o) for b, (t, o) in sorted(node[2].items())))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def common(a: tuple, b: tuple) -> int:
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    # a node is [is final, final output, {byte: (target, output)}]; path holds the unfrozen nodes of the last word
    path, last = [[False, (), {}]], b""
    pend: list[tuple[int, tuple]] = []  # (byte, output) of the arc from path[i] to path[i + 1]
    for word, ids in entries:
        n = common(last, word)
        while len(path) > n + 1:
            node = path.pop()
            byte, output = pend.pop()
            path[-1][2][byte] = (freeze(node), output)
        rest = tuple(ids)
        for i in range(n):  # outputs that the new word doesn't share go down one arc
            byte, output = pend[i]
            k = common(output, rest)
            if k < len(output):
                down = output[k:]
                child = path[i + 1]
                child[2] = {b: (t, down + o) for b, (t, o) in child[2].items()}
                if child[0]:
                    child[1] = down + child[1]
                if i + 1 < len(pend):
                    pend[i + 1] = (pend[i + 1][0], down + pend[i + 1][1])
                pend[i] = (byte, output[:k])
            rest = rest[k:]
        for i in range(n, len(word)):
            path.append([False, (), {}])
            pend.append((word[i], rest))
            rest = ()
        path[-1][0], path[-1][1] = True, rest
        last = word
    while len(path) > 1:
        node = path.pop()
        byte, output = pend.pop()
        path[-1][2][byte] = (freeze(node), output)
    root = freeze(path[0])

    outputs: dict[tuple, int] = {(): 0}
    pool: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)]

    def out(o: tuple) -> int:
        if o not in outputs:
            outputs[o] = len(place)
            place.append((len(pool), len(o)))
            pool.extend(o)
        return outputs[o]

    first, final, arcs = [0], [], []
    for is_final, output, links in states:
        final.append(out(output) + 1 if is_final else 0)
        arcs += [(b, t, out(o)) for b, t, o in links]
        first.append(len(arcs))
    tables = [np.array(first, np.int32), np.array(final, np.int32), np.array([a[0] for a in arcs], np.uint8), np.array([a[1] for a in arcs], np.int32), np.array([a[2] for a in arcs], np.int32), np.array(place, np.int32).ravel(), np.array(pool, np.int32)]
    head = struct.pack("<8i", root, *(len(t) for t in tables))
    return head + b"".join(t.tobytes() + b"\0" * (-t.nbytes % 4) for t in tables)


class Lexicon:
    """Compiled bytes, mapped from an unnamed file: the pages are the file's, and nothing stays behind."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        root, *sizes = struct.unpack_from("<8i", self.map)
        at, tables, places = 32, [], []
        for n, kind in zip(sizes, (np.int32, np.int32, np.uint8, np.int32, np.int32, np.int32, np.int32), strict=True):
            tables.append(memoryview(np.frombuffer(self.map, kind, n, at)))
            places.append(at)
            at += n * np.dtype(kind).itemsize
            at += -at % 4
        self.root, self.bytes_at = root, places[2]
        self.first, self.final, _, self.target, self.output, self.place, self.pool = tables
        at = dict(zip(("first", "final", "byte", "target", "output"), places))
        table = lambda name, k, kind: np.frombuffer(self.map, kind, sizes[k], at[name])
        first, byte = table("first", 0, np.int32), table("byte", 2, np.uint8)
        self._arcs = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | byte  # in order: states', and a state's by byte
        self._target, self._output, self._final = table("target", 3, np.int32), table("output", 4, np.int32), table("final", 1, np.int32)

    def get_all(self, words: list[bytes]) -> list[list[int] | None]:
        """get() of many words, byte by byte of all at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, alive = np.full(len(words), self.root), np.arange(len(words))
        out: list[list[int] | None] = [None] * len(words)
        some: dict[int, list[int]] = {}
        pool, place = self.pool, self.place
        for k in range(int(sizes.max(initial=0)) + 1):
            ended = alive[sizes[alive] == k]
            final = self._final[state[ended]]
            for i, f in zip(ended[final > 0].tolist(), (final[final > 0] - 1).tolist(), strict=True):
                out[i] = some.get(i, []) + list(pool[place[2 * f] : place[2 * f] + place[2 * f + 1]])
            alive = alive[sizes[alive] > k]
            if not len(alive) or not len(self._arcs):
                break
            key = state[alive] << 8 | data[starts[alive] + k]
            arc = np.minimum(np.searchsorted(self._arcs, key), len(self._arcs) - 1)
            there = self._arcs[arc] == key
            alive, arc = alive[there], arc[there]
            state[alive] = self._target[arc]
            given = self._output[arc]
            for i, o in zip(alive[given > 0].tolist(), given[given > 0].tolist(), strict=True):
                some.setdefault(i, []).extend(pool[place[2 * o] : place[2 * o] + place[2 * o + 1]])
        return out

    def get(self, word: bytes) -> list[int] | None:
        state, ids, first, base, find = self.root, [], self.first, self.bytes_at, self.map.find
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            if o := self.output[at]:
                ids += self.pool[self.place[2 * o] : self.place[2 * o] + self.place[2 * o + 1]]
            state = self.target[at]
        if not (f := self.final[state]):
            return None
        f -= 1
        return ids + list(self.pool[self.place[2 * f] : self.place[2 * f] + self.place[2 * f + 1]])


def _open(piece: str) -> bool:
    """Whether a space beside it isn't one space between two words."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


class Codec:
    """encode_all() and decode() with a vocabulary and a lexicon.

    The word pattern never goes from a character that is no white space over a white space, and one space between two such
    characters goes with what follows. So a text may be cut before each of those spaces, and pieces are looked up by
    themselves. What a batch's pieces are made of and isn't remembered goes to the lexicon together, and what that lacks is
    merged together."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon
        self.spaced: dict[str, list[int] | None] = {}  # pieces with one space before them; None: white space at an end
        self.bare: dict[str, list[int] | None] = {}
        self.known: dict[str, list[int]] = {}  # words
        n = max(vocabulary.pieces) + 1
        sizes = np.array([len(vocabulary.pieces.get(i, b"")) for i in range(n)])
        self.piece_at = np.concatenate([[0], np.cumsum(sizes)])
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.pieces.get(i, b"") for i in range(n)), np.uint8)

    def resolve(self, words: set[str]) -> None:
        """Ids of words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG_WORD]
        ids = dict(zip(short, self.lexicon.get_all([raw[k] for k in short]), strict=True))
        unseen = [k for k in short if ids[k] is None]
        ids.update(zip(unseen, self.v.merge_all([raw[k] for k in unseen]), strict=True))
        self.known.update((w, ids[k] if k in ids else self.v.merge(raw[k])) for k, w in enumerate(new))

    def words(self, text: str) -> list[int]:
        found = WORDS.findall(text)
        self.resolve(set(found))
        known = self.known
        return [i for w in found for i in known[w]]

    def forget(self, most: int = 0) -> None:
        """Start anew what has more than so many entries."""
        for memory in (self.spaced, self.bare, self.known):
            if len(memory) > most:
                memory.clear()

    def learn(self, texts: list[str]) -> None:
        """All pieces of the texts, so that looking them up is all that is left."""
        self.forget(CACHE_WORDS)
        spaced, bare = set(), set()
        for text in texts:
            pieces = text.split(" ")
            bare.add(pieces[0])
            spaced.update(pieces[1:])
        folded = [p for p in spaced - self.spaced.keys() if "\n" in p and not _open(p)]
        lines = {p: x for p in folded if not any(map(_open, x := p.split("\n")))}  # one line end between two words stands alone
        for x in lines.values():
            spaced.add(x[0])
            bare.update(x[1:])
        cut = {}
        for gap, memory, pieces in ((" ", self.spaced, spaced), ("", self.bare, bare)):
            for p in pieces - memory.keys():
                if _open(p):
                    memory[p] = None
                elif not (gap and p in lines):
                    cut[gap, p] = WORDS.findall(gap + p)
        self.resolve({w for found in cut.values() for w in found} | {"\n"})
        known = self.known
        for (gap, p), found in cut.items():
            (self.spaced if gap else self.bare)[p] = known[found[0]] if len(found) == 1 else [i for w in found for i in known[w]]
        for p, x in lines.items():
            self.spaced[p] = [*self.spaced[x[0]], *(i for y in x[1:] for part in (known["\n"], self.bare[y]) for i in part)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if self.v.split is None or not any(map(self.v.split.search, texts)):
            self.learn(texts)
            return list(map(self.plain, texts))
        parts = [self.v.split.split(t) for t in texts]  # every second one is an added token
        self.learn([p for ps in parts for p in ps[::2]])
        return [[i for k, p in enumerate(ps) for i in ([self.v.added[p]] if k % 2 else self.plain(p))] for ps in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def plain(self, text: str) -> list[int]:
        """The ids of a text without added tokens, whose pieces are learnt."""
        pieces = text.split(" ")
        ids = list(map(self.spaced.__getitem__, pieces[1:]))
        if None not in ids and (head := self.bare[pieces[0]]) is not None:
            return [*head, *chain.from_iterable(ids)]
        out, start = [], 0  # pieces that have white space beside the space between them go together
        for k in range(1, len(pieces) + 1):
            if k == len(pieces) or not (pieces[k - 1] and pieces[k]) or pieces[k - 1][-1].isspace() or pieces[k][0].isspace():
                if k < len(pieces):
                    continue
            if start and k == start + 1 and ids[start - 1] is not None:
                out += ids[start - 1]
            else:
                out += self.words(" " * (start > 0) + " ".join(pieces[start:k]))
            start = k
        return out

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The decoded texts, in UTF-8, of the runs of ids that offsets bound."""
        start = self.piece_at[ids]
        sizes = self.piece_at[ids + 1] - start
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.piece_bytes[np.arange(ends[-1]) - np.repeat(ends[:-1] - start, sizes)].tobytes()
        cuts = ends[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()


def frequent_words(docs: DataFrame, most: int) -> list[str]:
    """The most frequent words of all texts, `most` of them at most. Counted first in each batch, so a word meets the
    shuffle once for each batch at most."""

    def run(batches):
        for batch in batches:
            # words between white space that are letters alone; the pattern cuts others, which are merged when they come
            counts = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(pc.fill_null(batch.column(0), ""))))
            w, n = counts.field("values"), counts.field("counts")
            keep = pc.and_(pc.less(pc.binary_length(w), LONG_WORD), pc.match_substring_regex(w, "^\\p{L}+$"))
            yield pa.RecordBatch.from_arrays([w.filter(keep).cast(pa.string()), n.filter(keep)], ["w", "n"])

    counted = scratch(docs.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    # words by their count's size, from the greatest: the driver gets those of the sizes that fit the bound and no others
    size = F.floor(8 * F.log2("n"))
    tally = sorted(((r["size"], r["words"]) for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for k, words in tally:
        if total + words > most:
            break
        least, total = k, total + words
    return [] if least is None else [r["w"] for r in counted.where(size >= least).select("w").collect()]


def lexicon_of(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> bytes:
    words = {x for w in frequent_words(docs, most) for x in (w, " " + w)}
    return compile_lexicon([(w, vocabulary.merge(w)) for w in sorted(x.encode() for x in words)])


_codecs: dict[int, Codec] = {}


def _codec(key: int, vocabulary, lexicon) -> Codec:
    """One codec for each Python worker and broadcast."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(vocabulary.value), Lexicon(lexicon.value))
    return _codecs[key]


def encode(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, also: dict[str, str] | None = None, ids: bool = True) -> DataFrame:
    """doc_id, the columns named in `also`, n_tokens, ids (array<int>, if wanted), ids_sha256 and decoded_sha256.

    tokenizer is the path of a byte-level BPE's tokenizers file on the driver. A null text is encoded as the empty one,
    which has no tokens; the vocabulary's added tokens in a text are matched as the library does. Very long texts and words
    are encoded whole. Rows stay as they are, repeated ones too; ties in frequency enter the lexicon together or not at
    all; an empty table gives an empty table; further columns take no part."""
    import hashlib

    also = also or {}
    docs = pick(docs, doc_id="long", text="string", **{c: t for c, t in also.items() if c != "text"})
    sc = docs.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    compiled = lexicon_of(docs, Vocabulary(text), most)
    vocabulary, lexicon, key = sc.broadcast(text), sc.broadcast(compiled), hash((text, compiled))
    names = ["doc_id", *also, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]

    def run(batches):
        codec = _codec(key, vocabulary, lexicon)
        gc.disable()  # what is remembered is lists without cycles, which the collector would go through again and again
        try:
            yield from encoded(codec, batches)
        finally:
            codec.forget()  # the worker may go on with other work
            gc.enable()

    def encoded(codec, batches):
        for batch in batches:
            counts, flats, shas, decoded = [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(batch), 1024):  # in pieces, so that the temporaries stay small
                raw = [np.array(ids, "<u4") for ids in codec.encode_all(texts[lo : lo + 1024])]
                shas += [hashlib.sha256(r.tobytes()).hexdigest() for r in raw]
                here = [len(r) for r in raw]
                flat = np.concatenate([*raw, np.zeros(0, "<u4")])
                decoded += [hashlib.sha256(t).hexdigest() for t in codec.decode_all(flat.astype(np.int64), np.concatenate([[0], np.cumsum(here)]))]
                counts += here
                if ids:
                    flats.append(flat.astype(np.int32))
            columns = [batch.column(c) for c in ("doc_id", *also)] + [pa.array(counts, pa.int64())]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*flats, np.zeros(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names)

    types = {"doc_id": "long", **also, "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of ids, as the library's decode without skipping special tokens; null ids give an empty text."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    vocabulary = encoded.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        pieces = Vocabulary(vocabulary.value).pieces
        for batch in batches:
            out = [b"".join(map(pieces.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode(docs, tokenizer, ids=False)
