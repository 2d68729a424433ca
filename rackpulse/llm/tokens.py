"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

The vocabulary is a byte-level BPE with word ends (``word_bpe_49k.json``). A text is composed (NFC), lower-cased and cut
into words; a word's tokens depend on nothing outside it. Inside a word, a sequence of tokens is the BPE encoding
exactly if each two neighbours are what BPE makes of their joined bytes. So for each prefix the last token of its
encoding is the one token that ends there and may follow the last token of the shorter prefix: one step per candidate, no
re-encoding. Counts of prefixes add up over the words, and the table answers how many tokens any prefix has and which
is the longest prefix within a budget.

Words are processed by numpy for all new words of a chunk of text at once, position by position; results are kept
per worker for up to ``MAX_WORDS`` words (then started afresh: memory, not results, depends on it).

Defined cases: a null text counts as empty (0 tokens, 1 prefix); special strings inside texts are one token each, as the
library takes them by default, and a prefix that ends inside one is ordinary text; prefixes are those of the composed
lower-cased text (as many characters as the text itself but for a few letters); rows are independent, so repeated
rows, ties and further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import table, worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Characters of text that are taken at a time; words that a worker remembers; lengths in bytes that go together.
CHUNK, MAX_WORDS, WIDTHS = 1 << 21, 1_000_000, (8, 12, 18, 28, 48)
#: Words of more bytes are counted one by one.
LONG = 512
LIMIT = 2048
END = "</w>"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Fixed values of the vocabulary's word pattern: these are words of their own where an apostrophe starts a word.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Letters of a later Unicode version that the tokenizer library knows.
LATER_LETTERS = (0xA7CB, 0xA7DC, 0x13808, 0x1385C, 0x13988)
LATER_LOWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}
_U = np.uint64
_B, _K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def character_classes() -> np.ndarray:
    white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in white else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[list(LATER_LETTERS)] = LETTER
    return out


class _Slots:
    """A fixed open-addressing table from 64-bit keys to numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = _U(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8)))))
        n = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(n + 64, _U), np.full(n + 64, -1, np.int32)
        for k, v in zip(keys, values, strict=True):
            at = int((k * _K1) >> self.shift)
            while self.values[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = k, v

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _K1) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        while len(open_):  # the next slots of those that met another key
            at[open_] += 1
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_] = np.where(hit, self.values[here], -1)
            open_ = open_[~hit & (self.values[here] >= 0)]
        return out


class PrefixCounter:
    """Token counts of all prefixes, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_symbols())}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        raw = {t: bytes(symbols[c] for c in t.removesuffix(END)) for t in vocab if t not in self.special}
        self.classes = character_classes()
        self.powers, self.back = np.ones(1, _U), np.ones(1, _U)
        self.merge_rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}  # token -> left part, right part, rank of the merge that makes it
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.merge_rank[a << 32 | b] = rank
            parts.setdefault(vocab[left + right], (a, b, rank))
        # the pieces at a token's two ends over time: (piece, rank of the merge in which it goes up)
        self.right_ends, self.left_ends = [[[] for _ in range(max(vocab.values()) + 1)] for _ in range(2)]
        for t in vocab.values():
            for side, ends in ((1, self.right_ends), (0, self.left_ends)):
                at, until = t, _NONE
                ends[t].append((at, until))
                while at in parts:
                    at, until = parts[at][side], parts[at][2]
                    ends[t].append((at, until))
        self.longest = max(map(len, raw.values()))
        inner = {vocab[t]: b for t, b in raw.items() if not t.endswith(END)}
        final = {vocab[t]: b for t, b in raw.items() if t.endswith(END)}
        self.inner, self.final = self._slots(inner), self._slots(final)
        # for long words, token by token: their bytes, and all bytes that some token ends with
        self.inner_of, self.final_of = ({b: t for t, b in own.items()} for own in (inner, final))
        self.tails = {b[i:] for b in raw.values() for i in range(len(b))}
        self.seen_keys, self.seen = np.zeros(1 << 20, _U), np.zeros(1 << 20, np.int8)
        self.verdicts: dict[int, bool] = {}
        self._forget()

    # ---- which token may follow which

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens ``a b`` as they are: no merge across them comes before those that make them."""
        rank_of = self.merge_rank.get
        for x, x_until in self.right_ends[a]:
            for y, y_until in self.left_ends[b]:
                rank = rank_of(x << 32 | y)
                if rank is not None and rank < x_until and rank <= y_until and self._stand(a, x, b, y, rank):
                    return False
        return True

    def _stand(self, a: int, x: int, b: int, y: int, rank: int) -> bool:
        """Whether pieces x and y are there when the merge ``rank`` has its turn: made by earlier merges."""
        return True if x == y == -1 else self._made(a, x, self.right_ends) < rank and self._made(b, y, self.left_ends) < rank

    @staticmethod
    def _made(token: int, piece: int, ends: list) -> int:
        below = [until for (p, _), (_, until) in zip(ends[token], ends[token][1:], strict=False) if p == piece]
        return below[0] if below else -1

    def _follows(self, prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
        keys = (prev.astype(_U) << _U(32)) | tok.astype(_U) | _U(1 << 63)
        at = ((keys * _K1) >> _U(44)).astype(np.int64)
        miss = np.flatnonzero(self.seen_keys[at] != keys)
        out = self.seen[at].astype(bool)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            if len(self.verdicts) > 2_000_000:
                self.verdicts.clear()
            got = np.empty(len(new), bool)
            for i, k in enumerate(new.tolist()):
                v = self.verdicts.get(k)
                if v is None:
                    v = self.verdicts[k] = self.may_follow((k >> 32) & 0x7FFFFFFF, k & 0xFFFFFFFF)
                got[i] = v
            out[miss] = got[back]
            slots = ((new * _K1) >> _U(44)).astype(np.int64)
            self.seen_keys[slots], self.seen[slots] = new, got
            clash = self.seen_keys[slots] != new  # two new keys for one slot: the last written stays, with its verdict
            if clash.any():
                self.seen_keys[slots[clash]] = 0
        return out

    # ---- words

    def _slots(self, tokens: dict[int, bytes]) -> _Slots:
        hashes = []
        for b in tokens.values():
            h = 0
            for c in b:
                h = (h * int(_B) + c + 1) & (1 << 64) - 1
            hashes.append(h)
        assert len(set(hashes)) == len(hashes)
        return _Slots(np.array(hashes, _U), np.array(list(tokens), np.int64))

    def _forget(self) -> None:
        """word hash -> row; per row: first entry in ``flat`` and number of characters; flat: counts of a word's prefixes."""
        self.rows: dict[int, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str], hashes: list[int]) -> None:
        """Add words to the table: the counts of their prefixes of 1, 2, ... characters, the last being the word's own."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(words)), key=lambda i: len(coded[i]))
        flats, sizes, start = [self.flat], [self.size], 0
        short = sum(len(c) <= LONG for c in coded)
        while start < short:  # words of like length together
            least, stop = len(coded[order[start]]), start
            width = next((w for w in WIDTHS if w >= least), least * 2)
            while stop < short and len(coded[order[stop]]) <= width and (stop - start) * width < 1 << 22:
                stop += 1
            flat, size = self._prefix_dp([coded[i] for i in order[start:stop]])
            flats.append(flat)
            sizes.append(size)
            start = stop
        for i in order[short:]:
            flats.append(self._long_prefix_dp(coded[i]))
            sizes.append(np.array([len(flats[-1])]))
        n = len(self.size)
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size
        for row, i in enumerate(order, n):
            self.rows[hashes[i]] = row
            if words[i] in CONTRACTIONS and len(words[i]) == 3:  # cut, they are an apostrophe and a letter
                self.flat[self.first[row]:self.first[row] + 2] = 1, 2

    def _prefix_dp(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all words' prefixes, word after word, and each word's number of characters."""
        n, lengths = len(coded), np.array([len(b) for b in coded])
        wide = int(lengths.max())
        text = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in coded), np.uint8).reshape(n, wide)
        sums = np.zeros((wide + 1, n), _U)
        for i in range(wide):
            sums[i + 1] = sums[i] * _B + text[:, i] + _U(1)
        power = [_U(1)]
        with np.errstate(over="ignore"):
            for _ in range(min(wide, self.longest)):
                power.append(power[-1] * _B)
        # of the prefix of i bytes: last token and number of tokens if the word goes on, and number if it ends here
        last, going, ended = np.zeros((wide + 1, n), np.int64), np.zeros((wide + 1, n), np.int32), np.zeros((wide + 1, n), np.int32)
        for end in range(1, wide + 1):
            alive = np.flatnonzero(lengths >= end)
            for tokens, is_final in ((self.inner, False), (self.final, True)):
                rows = alive
                for size in range(min(end, self.longest), 0, -1):
                    if not len(rows):
                        break
                    tok = tokens.find(sums[end][rows] - sums[end - size][rows] * power[size])
                    some = np.flatnonzero(tok >= 0)
                    if end > size:
                        some = some[self._follows(last[end - size][rows[some]], tok[some])]
                    at = rows[some]
                    if is_final:
                        ended[end, at] = going[end - size, at] + 1
                    else:
                        last[end, at], going[end, at] = tok[some], going[end - size, at] + 1
                    keep = np.ones(len(rows), bool)
                    keep[some] = False
                    rows = rows[keep]
        whole = np.ones((n, wide), bool)  # where a character ends
        whole[:, :-1] = (text[:, 1:] & 0xC0) != 0x80
        whole &= np.arange(1, wide + 1) <= lengths[:, None]
        whole[np.arange(n), lengths - 1] = True
        return ended[1:].T[whole], whole.sum(1)

    def _long_prefix_dp(self, word: bytes) -> np.ndarray:
        """The same for one long word, byte by byte: only bytes that some token ends with are looked up."""
        last, going = [-1], [0]
        pairs: dict[int, bool] = {}
        counts = []
        for end in range(1, len(word) + 1):
            inner, final, size = [], [], 1
            while size <= end and (tail := word[end - size:end]) in self.tails:
                if (t := self.inner_of.get(tail)) is not None:
                    inner.append((size, t))
                if (t := self.final_of.get(tail)) is not None:
                    final.append((size, t))
                size += 1
            ends = end == len(word) or word[end] & 0xC0 != 0x80  # where a character ends
            for tokens, is_final in ((inner, False), (final if ends else (), True)):
                found = -1, 0
                for size, t in reversed(tokens):
                    before = last[end - size]
                    if end > size:
                        ok = pairs.get(before << 32 | t)
                        if ok is None:
                            ok = pairs[before << 32 | t] = self.may_follow(before, t) if before >= 0 else False
                    if end == size or ok:
                        found = t, going[end - size] + 1
                        break
                if is_final:
                    counts += [found[1]] if ends else []
                else:
                    last.append(found[0])
                    going.append(found[1])
        return np.array(counts, np.int32)

    # ---- texts

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """Parts of the composed lower-cased text and how each counts: 0 text, 1 special string."""
        if not self.special_re or "<" not in text:
            return [(self.normal(text), 0)]
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [(self.normal(text[at:m.start()]), 0), (m[0], 1)]
            at = m.end()
        return [*out, (self.normal(text[at:]), 0)]

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text if text.isascii() else text.translate(LATER_LOWER)

    def prefix_counts(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Per text the token counts of its prefixes of 0, 1, 2, ... characters."""
        held: list[list[tuple[str, int]]] = []
        size = 0
        for text in texts:
            held.append(self.pieces(text or ""))
            size += sum(len(p) for p, _ in held[-1])
            if size >= CHUNK:
                yield from self._counted(held)
                held, size = [], 0
        yield from self._counted(held)

    def _counted(self, held: list[list[tuple[str, int]]]) -> Iterator[np.ndarray]:
        parts: list[str] = []
        for own in held:
            parts.extend(p for p, kind in own if not kind)
            for (before, _), (special, kind) in zip(own, own[1:], strict=False):
                if kind:  # a prefix that ends inside the special string is ordinary text
                    parts.append(before + special[:-1])
        tables = iter(self._count_parts(parts))
        for own in held:
            plain = [next(tables) for _, kind in own if not kind]
            cut = [next(tables) for _, kind in own if kind]
            if not cut:
                yield plain[0]
                continue
            out, base = [np.zeros(1, np.int32)], 0
            for i, (special, counts) in enumerate(zip([p for p, kind in own if kind], cut, strict=True)):
                out += [base + plain[i][1:], base + counts[-len(special) + 1:]]
                base += int(plain[i][-1]) + 1
                out.append(np.array([base], np.int32))
            yield np.concatenate([*out, base + plain[-1][1:]]).astype(np.int32)

    def _count_parts(self, parts: list[str]) -> Iterator[np.ndarray]:
        if not parts:
            return
        text = "\n".join(parts) + "\n"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[code]
        starts, ends = self._words(text, code, kind)
        hashes = self._hashes(code, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.rows) + len(unique) > MAX_WORDS:
            self._forget()
        rows = self.rows
        missing = [i for i, h in enumerate(unique.tolist()) if h not in rows]
        if missing:
            self._learn([text[starts[first[i]]:ends[first[i]]] for i in missing], unique[missing].tolist())
        row = np.array([rows[h] for h in unique.tolist()], np.int64)[back]
        at, size = self.first[row], self.size[row]
        counts = self.flat[at + size - 1]
        # tokens of the words that end by each place, and of the word around it so far
        total = np.zeros(len(code) + 1, np.int32)
        total[ends] = counts
        total = np.cumsum(total, dtype=np.int32)
        inside = size - 1
        if inside.any():
            within = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
            total[np.repeat(starts + 1, inside) + within] += self.flat[np.repeat(at, inside) + within]
        place = 0
        for p in parts:
            yield total[place:place + len(p) + 1] - total[place]
            place += len(p) + 1

    def _words(self, text: str, code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = kind != SPACE
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        for at in np.flatnonzero((code == 39) & new).tolist():
            for c in CONTRACTIONS:
                if text.startswith(c, at):
                    new[at + 1:at + len(c)] = False
                    new[at + len(c)] = kind[at + len(c)] != SPACE  # the part ends with white space
                    break
        starts = np.flatnonzero(new)
        gap = np.flatnonzero((kind[1:] == SPACE) & (kind[:-1] != SPACE)) + 1
        stop = np.zeros(len(kind), bool)
        stop[gap] = True
        stop |= new
        bounds = np.flatnonzero(stop)
        return starts, bounds[np.searchsorted(bounds, starts, "right")] if len(starts) else starts

    def _hashes(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        while len(self.powers) <= len(code) + 1:
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * _U(pow(int(_B), n, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * _U(pow(int(_B), -n, 1 << 64))])
        sums = np.zeros(len(code) + 1, _U)
        np.cumsum(((code.astype(_U) + _U(1)) * _K2 ^ _K1) * self.powers[:len(code)], out=sums[1:])
        # brought back to power 0 at the word's start, then mixed with the length
        out = (sums[ends] - sums[starts]) * self.back[starts]
        out = (out ^ (out >> _U(29))) * _K1 + (ends - starts).astype(_U)
        return out ^ (out >> _U(32))


def counter(path: str) -> PrefixCounter:
    return worker_cache(f"tokens:{path}", lambda: PrefixCounter(path))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def prefix_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, prefix_tokens): the whole table, an array of the counts of all prefixes of each text."""
    return _mapped(docs, path, "prefix_tokens array<int>", lambda counts: {"prefix_tokens": counts})


def token_budgets(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars): read off the table: the tokens of the whole text, and the characters of
    its longest prefix of at most ``limit`` tokens."""
    def answers(counts: np.ndarray) -> dict:
        fits = len(counts) - 1 if counts[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1])
        return {"n_tokens": int(counts[-1]), "fit_chars": fits}
    return _mapped(docs, path, "n_tokens long, fit_chars long", answers)


def _mapped(docs: DataFrame, path: str | None, schema: str, answer) -> DataFrame:
    path = path or vocabulary_path()
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        with np.errstate(over="ignore"):
            own = counter(path)
            for batch in batches:
                texts = batch.column("text")
                out: dict[str, list] = {n: [] for n in names}
                for counts in own.prefix_counts(t.as_py() for t in texts):
                    for k, v in answer(counts).items():
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}
                    | {n: pa.array(v, pa.list_(pa.int32()) if "array" in schema else pa.int64()) for n, v in out.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
                       ).mapInArrow(run, f"doc_id {kind}, n_bytes long, {schema}")


def op1_token_counts(spark, sf_dir) -> DataFrame:
    found = token_budgets(table(spark, sf_dir, "documents"), LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
