"""BPE encoding and decoding by speculate and verify.

For each word not met before, greedy longest match over the vocabulary proposes tokens:
all new words walk the trie of its tokens together, a byte at a time.  A proposal is the BPE encoding exactly if each token is the encoding of its own text
and no adjacent pair would have merged across its border.  The second is tested for all
adjacent pairs of all new words at once: both sides of the border are unmerged step by
step in numpy, the later merge first, and a pair fails when a merge across the border
would have come before one that was undone.  Words that fail are merged exactly.

The vocabulary is that of a word-end BPE file of the tokenizers library: NFC, lower
case, white space dropped, byte-level symbols, no decoder (tokens joined by a space).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import ship

#: Entries of a worker's word cache; past it the cache starts anew (results don't depend on it).
CACHE = 150_000
#: Bytes of a word that walks with the others; longer ones go one by one, so that they don't hold up the rest.
WALKING = 64
_END = "</w>"
#: Controls that str.split() takes for white space, but the vocabulary's pattern doesn't.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Table:
    """Whole numbers by whole numbers from 0 on, looked up many at a time: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value, self.none = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int64), none
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] < 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[put]], self.value[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.key[slot], self.value[slot]
        other = np.flatnonzero(found != keys)
        other = other[found[other] >= 0]
        out[other] = self.none
        while len(other):  # on to the next places, as far as they are taken
            slot[other] = (slot[other] + 1) & self.mask
            found = self.key[slot[other]]
            same = found == keys[other]
            out[other[same]] = self.value[slot[other[same]]]
            other = other[~same & (found >= 0)]
        return out


class WordBPE:
    """One vocabulary, its pair tables, and the cache of words met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with word ends and without decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.text = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.text[i] = t
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        # by token: the merge that makes it (none: -1) and its two sides
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for i, (a, b) in enumerate(pairs):
            t = self.vocab[a + b]
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = i, self.vocab[a], self.vocab[b]
        keys = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in pairs], np.int64)
        self.rank_of = _Table(keys, np.arange(len(keys)), len(keys))
        self.sound = self._sound()
        self.symbols = byte_symbols()
        short = lambda t: t[: -len(_END)] + "\0" if t.endswith(_END) else t  # noqa: E731  the word end as one character
        self.by_text = {short(t): i for t, i in self.vocab.items() if self.sound[i]}
        self.longest = max(map(len, self.by_text))
        # by byte: its token inside a word, and at its end (none: -1)
        self.inside, self.final = (np.array([self.vocab.get(c + e, -1) for c in self.symbols], np.int64) for e in ("", _END))
        self._plant()
        specials = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({specials})")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.proposed = self.failed = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair: whether no merge across its border precedes those inside a and b.

        limit: only merges before it count (default: all)."""
        a, b = a.copy(), b.copy()
        most = np.full(len(a), self.rank_of.none, np.int64) if limit is None else limit.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self._ranks(x, y)
            # merges of equal rank happen from the left: one inside the left side precedes one across
            bad = rank < most[live]
            ok[live[bad]] = False
            mx, my = self.made[x], self.made[y]
            done = (mx < 0) & (my < 0)
            undo_left = mx > my
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left | done, y, self.left[y])
            # across the border before the undone merge: a merge of a's end at rank r beats one of rank r across, b's doesn't
            most[live] = np.where(undo_left, mx, my + 1)
            live = live[~bad & ~done]
        return ok

    def _sound(self) -> np.ndarray:
        """Tokens that are the encoding of their own text."""
        ok = np.ones(len(self.made), bool)
        merged = np.flatnonzero(self.made >= 0)
        ok[merged] = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        for _ in range(64):
            new = ok & ok[self.left] & ok[self.right]
            if np.array_equal(new, ok):
                break
            ok = new
        return ok

    def greedy(self, word: str) -> list[int] | None:
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if end != n - 1 and (t := self.by_text.get(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
            else:
                return None
        return out

    def _plant(self) -> None:
        """The trie of the proposed tokens: children by node and byte (256: the word's end), tokens by node."""
        code = {c: i for i, c in enumerate(self.symbols)} | {"\0": 256}
        child: dict[int, int] = {}
        token = {}
        for t, i in self.by_text.items():
            node = 0
            for c in t:
                node = child.setdefault(node * 257 + code[c], len(child) + 1)
            token[node] = i
        self.child = _Table(np.array(list(child), np.int64), np.array(list(child.values()), np.int64), -1)
        self.token_at = np.full(len(child) + 1, -1, np.int64)
        self.token_at[list(token)] = list(token.values())

    def propose(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their words) of greedy longest match, in order, for words of so many bytes each; a word that has no match has none."""
        stop = np.cumsum(size + 1)
        seq = np.full(int(stop[-1]) if len(stop) else 0, 256, np.int64)
        seq[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = codes
        lane, pos = np.arange(len(size)), stop - size - 1
        node, best, after = np.zeros_like(pos), np.full_like(pos, -1), pos.copy()
        out, of, none = [], [], []
        while len(lane):
            to = self.child.get(node * 257 + seq[np.minimum(pos, len(seq) - 1)])
            to[pos == stop] = -1
            go = to >= 0
            pos = pos + go
            token = self.token_at[to]  # of those that go on
            hit = np.flatnonzero(go & (token >= 0) & (pos != stop - 1))
            best[hit], after[hit] = token[hit], pos[hit]
            node = np.where(go, to, 0)
            ended = np.flatnonzero(~go)
            if not len(ended):
                continue
            lost = best[ended] < 0
            out.append(best[ended[~lost]])
            of.append(lane[ended[~lost]])
            none.append(lane[ended[lost]])
            pos[ended], best[ended] = after[ended], -1
            over = np.zeros(len(lane), bool)
            over[ended] = lost | (pos[ended] == stop[ended])
            if over.any():
                lane, pos, stop, node, best, after = (x[~over] for x in (lane, pos, stop, node, best, after))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, owner = np.concatenate(out), np.concatenate(of)
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
        whole = np.ones(len(size), bool)
        whole[np.concatenate(none)] = False
        return flat[whole[owner]], owner[whole[owner]]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; the number of merges where there is none."""
        return self.rank_of.get((a << 32) | b)

    def exact(self, shown: list[str]) -> list[np.ndarray]:
        """For each word (in signs, and its end): merges by rank, from the left, until none applies; all words advance together."""
        vocab = self.vocab
        tok = np.array([vocab[c] for s in shown for c in (*s[:-2], s[-2] + _END)], np.int64)
        return self._merge(tok, np.array([len(s) - 1 for s in shown], np.int64))

    def _merge(self, tok: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The same for words that are so many tokens each."""
        if (tok < 0).any():
            raise KeyError("a byte that the vocabulary lacks")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        none = self.rank_of.none
        out: list[np.ndarray] = [tok[:0]] * len(sizes)
        while len(tok):
            rank = np.full(len(tok), none)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._ranks(tok[inner], tok[inner + 1])
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(tok)])
            for i in np.flatnonzero(low == none).tolist():
                out[owner[head[i]]] = tok[head[i] : head[i] + size[i]]
            low = np.repeat(low, size)
            hit = (rank == low) & (low < none)
            if not hit.any():
                break
            # of hits in a row (x x x) every other one counts, from the left
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, 0, np.arange(len(hit)) + 1))
            hit &= run % 2 == 0
            at = np.flatnonzero(hit)
            tok[at] = self.merged[rank[at]]
            stay = low < none
            stay[at + 1] = False
            tok, owner = tok[stay], owner[stay]
        return out

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of new words into the cache."""
        raw = [w.encode() for w in words]
        codes, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        walks = size <= WALKING
        flat, owner = self.propose(codes[np.repeat(walks, size)], size[walks])
        owner = np.flatnonzero(walks)[owner]
        long = [(i, t) for i in np.flatnonzero(~walks).tolist() if (t := self.greedy("".join([self.symbols[c] for c in raw[i]]) + "\0"))]
        if long:
            flat, owner = np.concatenate([flat, *(t for _, t in long)]), np.concatenate([owner, *(np.full(len(t), i) for i, t in long)])
        bad = np.bincount(owner, minlength=len(words)) == 0
        inner = owner[1:] == owner[:-1]
        bad[owner[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]] = True
        self.proposed += len(words)
        self.failed += int(bad.sum())
        again = np.flatnonzero(bad)
        of, last = codes[np.repeat(bad, size)], np.cumsum(size[again]) - 1
        tok = self.inside[of]
        tok[last] = self.final[of[last]]
        for i, t in zip(again.tolist(), self._merge(tok, size[again]), strict=True):
            self.words[words[i]] = t.astype("<u4").tobytes()
        good = ~bad[owner]
        flat, owner = flat[good].astype("<u4").tobytes(), owner[good]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        ends = 4 * np.r_[first[1:], len(owner)][: len(first)]
        for i, x, y in zip(owner[first].tolist(), (4 * first).tolist(), ends.tolist(), strict=True):
            self.words[words[i]] = flat[x:y]

    def _parts(self, chunk: str) -> list[str]:
        if chunk.isascii():
            if chunk.isalpha():  # one run of letters
                return [chunk.lower()]
        else:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower case goes by character, without the final sigma
        return self.pattern.findall(chunk.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE or len(self.chunks) > CACHE:
            self.words, self.chunks = {}, {}
        split = []
        for t in texts:
            if "<|" in t and self.split_special.search(t):
                split.append([y for x in self.split_special.split(t) for y in ([x] if x in self.special else self._chunks(x))])
            else:
                split.append(self._chunks(t))
        fresh = list(set().union(*split) - self.chunks.keys())
        parts = [[c] if c in self.special else self._parts(c) for c in fresh]
        for t, i in self.special.items():
            self.words.setdefault(t, np.array([i], "<u4").tobytes())
        new = list({p for x in parts for p in x} - self.words.keys())
        if new:
            self.learn(new)
        for c, x in zip(fresh, parts, strict=True):
            self.chunks[c] = self.words[x[0]] if len(x) == 1 else b"".join([self.words[p] for p in x])
        look = self.chunks.__getitem__
        return [b"".join(map(look, x)) for x in split]

    def _chunks(self, text: str) -> list[str]:
        """Pieces between white space: no word of the pattern spans it."""
        return [c for c in regex.split(r"\p{White_Space}+", text) if c] if _NOT_SPACE.search(text) else text.split()

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def _load(path: str) -> WordBPE:
    return WordBPE(path)


def _slices(values: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of about `most` characters, so that lists of words stay short-lived and small."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without its texts, with `out`: their ids, packed as little-endian unsigned 32-bit integers (binary).

    As the tokenizers library does with the vocabulary file at `path` (a path on every
    executor), no special tokens added, no truncation or padding; special strings in a text
    are special tokens.  decoded: a column for what decode makes of those ids, in the same
    pass.  Null and empty texts have no ids; very long texts are encoded whole; repeated rows
    come back as often; columns named as the new ones are replaced; no rows, no result.
    """
    ship(df.sparkSession)
    new = [out] + [decoded] * bool(decoded)
    keep = [c for c in df.columns if c not in (*new, text_col)]
    thin = df.select(*[f"`{c}`" for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path)
        for b in batches:
            texts = [x or "" for x in b.column(len(keep)).to_pylist()]
            for i, j in _slices(texts):
                ids = bpe.encode(texts[i:j])
                cols = [*b.slice(i, j - i).columns[: len(keep)], pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    schema = thin.schema.add(out, "binary")
    return df.select(*[f"`{c}`" for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema.add(decoded, "string") if decoded else schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the texts of packed ids, special tokens included, as the library's decode gives them.  Null ids: empty text."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != out]
    place = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path)
        for b in batches:
            texts = [bpe.decode(x or b"") for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, df.select(*[f"`{c}`" for c in keep]).schema.add(out, "string"))
