"""Encoding with a BPE piece model by a table of prefixes, and decoding.

The encoding of a text's prefix ends in exactly one token. If the token p ends the encoding of a shorter
prefix and the token t continues it, then t ends the longer prefix just when the pair (p, t) is compatible: when
encoding the two tokens' joined text gives p and t again. So, for each prefix in turn, an automaton over all
pieces reports those that end there, longest first, and the first one compatible with the last token of the
prefix before it is stored. The ids are then read off the table backwards.

No piece has the mark for a space after another character, and none holds a character that is no piece itself. So
texts are cut before marks and around such characters, and the parts, words below, are encoded one by one. The
distinct words of a batch go through the automaton together, a character of all of them at a time, as numpy columns:
the table of prefixes has a row for each word. Words that are long or have rare characters take the same steps alone.
A worker remembers the words that it has met lately.

Fixed behaviour of the model that this module relies on and that ``PieceModel`` checks: BPE with byte fallback,
no normalisation, a space mark put before the text, spaces kept as they are.

Defined results: a null or empty text has no ids and decodes to an empty text; characters that no piece has
become the byte tokens of their UTF-8 form; texts of any length are encoded whole; repeated rows each get a row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, parts_of, small_batches, tidy

MARK = "▁"
#: Words in the younger of two generations that a Python worker remembers, and compatible or incompatible pairs.
WORDS_KEPT, PAIRS_KEPT = 100_000, 1 << 19
#: Characters that the automaton over columns knows, and the longest words that it takes, how many at once.
ALPHABET, LONGEST, TOGETHER = 224, 40, 1 << 15
#: Code points of text that are encoded together.
BATCH_CHARS = 2_000_000



class Pairs:
    """A map from pairs of tokens to whether they are compatible: open addressing in one array, read by columns."""

    def __init__(self, fits):
        self.fits, self.slots = fits, np.full(2 * PAIRS_KEPT, -1, np.int64)
        self.few: dict[tuple[int, int], bool] = {}
        self.shift, self.used = np.uint64(64 - (2 * PAIRS_KEPT).bit_length() + 1), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """For each key 0 or 1, or -1 if it is not here."""
        out, rows, at = np.full(len(keys), -1, np.int8), np.arange(len(keys)), self._home(keys)
        while len(rows):
            held = self.slots[at]
            hit = held >> 1 == keys
            out[rows[hit]] = held[hit] & 1
            go = ~hit & (held >= 0)
            rows, keys, at = rows[go], keys[go], (at[go] + 1) % len(self.slots)
        return out

    def _put(self, key: int, fits: bool) -> None:
        at = int(self._home(np.array([key]))[0])
        while self.slots[at] >= 0:
            at = (at + 1) % len(self.slots)
        self.slots[at] = key << 1 | fits

    def one(self, p: int, t: int) -> bool:
        known = self.few.get((p, t))
        if known is None:
            if len(self.few) >= PAIRS_KEPT:
                self.few.clear()
            known = self.few[p, t] = self.fits(p, t)
        return known

    def of(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        keys = p.astype(np.int64) << 31 | t
        out = self._found(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            if self.used + len(distinct) > PAIRS_KEPT:
                self.slots[:], self.used = -1, 0
            fits = np.array([self.fits(k >> 31, k & (1 << 31) - 1) for k in distinct.tolist()], bool)
            for k, f in list(zip(distinct.tolist(), fits.tolist(), strict=True))[:PAIRS_KEPT]:
                self._put(k, f)
            self.used += min(len(distinct), PAIRS_KEPT)
            out[new] = fits[back]
        return out.astype(bool)


class Columns:
    """The automaton as arrays: next state by state and character, and by state the longest piece that ends there and
    the state of the next shorter one."""

    def __init__(self, pieces: dict[str, int], chars: list[str]):
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: i + 1 for i, c in enumerate(chars)}
        children: list[dict[int, int]] = [{}]
        token, depth, levels = [-1], [0], [[0]]
        for piece, i in pieces.items():
            if not all(c in number for c in piece):
                continue
            at = 0
            for d, c in enumerate(piece):
                after = children[at].get(number[c])
                if after is None:
                    after = children[at][number[c]] = len(children)
                    children.append({})
                    token.append(-1)
                    depth.append(d + 1)
                    if len(levels) == d + 1:
                        levels.append([])
                    levels[d + 1].append(after)
                at = after
            token[at] = i
        self.token, self.depth = np.array(token, np.int32), np.array(depth, np.int32)
        self.after = np.zeros((len(children), len(chars) + 1), np.int32)
        back = np.zeros(len(children), np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        for level in levels:
            for at in level:
                if at:
                    self.after[at] = self.after[back[at]]
                for c, child in children[at].items():
                    back[child] = self.after[at, c]
                    self.after[at, c] = child
                b = back[at]
                self.shorter[at] = b if token[b] >= 0 else self.shorter[b]
        self.longest = np.where(self.token >= 0, np.arange(len(children)), self.shorter)
        if len(children) <= 1 << 16:
            self.after = self.after.astype(np.uint16)

    def encode(self, words: list[str], pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that this can encode, their ids one after the other, and where and how many each one's are.
        Left out are words with a character beyond the alphabet and those of more than ``LONGEST``."""
        flat = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        fit = (size <= LONGEST) & (np.minimum.reduceat(flat, start) > 0)
        rows = np.flatnonzero(fit)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        size, start, n = size[rows], start[rows], len(rows)
        # by word and end of a prefix: its last token and that one's length
        last, width = np.full((n, LONGEST + 1), -1, np.int32), np.zeros((n, LONGEST + 1), np.int32)
        state = np.zeros(n, np.int32)
        for end in range(1, int(size[0]) + 1 if n else 1):
            k = int(np.searchsorted(-size, -end, "right"))
            state[:k] = self.after[state[:k], flat[start[:k] + end - 1]]
            node, rest = self.longest[state[:k]], np.arange(k)
            while len(rest):
                begin, t = end - self.depth[node], self.token[node]
                p = last[rest, begin]
                fits = begin == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = pairs.of(p[inner], t[inner])
                last[rest[fits], end], width[rest[fits], end] = t[fits], end - begin[fits]
                node, rest = self.shorter[node[~fits]], rest[~fits]
                node, rest = node[node > 0], rest[node > 0]
        # read the ids backwards, the last ones of all words first
        at, count, left, steps = size.copy(), np.zeros(n, np.int64), np.arange(n), []
        while len(left):
            steps.append((left, last[left, at[left]]))
            count[left] += 1
            at[left] -= width[left, at[left]]
            left = left[at[left] > 0]
        begin = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for k, (left, t) in enumerate(steps):
            ids[begin[left] + count[left] - 1 - k] = t
        return rows, ids, begin, count


class PieceModel:
    def __init__(self, model: bytes):
        import sentencepiece.sentencepiece_model_pb2 as pb

        spec = pb.ModelProto.FromString(model)
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are and put a space mark first are supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.names: dict[int, str] = {}
        for i, p in enumerate(spec.pieces):
            self.names[i] = p.piece if p.type in (1, 4) else ""
            if p.type == 1:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
            elif p.type == 6:
                self.bytes[i] = int(p.piece[3:5], 16)
            elif p.type not in (2, 3):
                raise ValueError(f"pieces of type {p.type} are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        chars = {p for p in self.ids if len(p) == 1}
        if MARK not in chars or any(not chars.issuperset(p) for p in self.ids):
            raise ValueError("a piece has a character that is no piece")
        known = "".join(re.escape(c) for c in sorted(chars - {MARK}))
        self.cut = re.compile(f"{MARK}+[{known}]*|[{known}]+|.", re.DOTALL)
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        #: Pieces that merging gives; others never end an encoding.
        self.whole = {piece: i for piece, i in self.ids.items() if self._merged(piece) == [piece]}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.whole.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        common = Counter(c for piece in self.whole for c in set(piece))
        chars = sorted((c for c in common if c in self.whole), key=lambda c: (ord(c) > 127, -common[c], c))[:ALPHABET]
        self.columns = Columns(self.whole, chars)
        self.pairs = Pairs(self._fits)
        self.ids_told = np.array([str(i) for i in range(len(spec.pieces))], object)
        self.pieces = np.array([self.names[i] for i in range(len(spec.pieces))], object)
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _merged(self, text: str) -> list[str]:
        """Encode a short text by merging neighbours, the best piece first and of equal ones the left one."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, p: int, t: int) -> bool:
        a, b = self.names[p], self.names[t]
        return self._merged(a + b) == [a, b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one part of a cut text."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        if word not in self.ids and len(word) == 1:
            return [self.byte_ids[b] for b in word.encode()]
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (t, k) in self.automaton.iter(word):
            begin = end + 1 - k
            if size[end + 1] or begin and not self.pairs.one(last[begin], t):
                continue
            last[end + 1], size[end + 1] = t, k
        out: list[int] = []
        at = n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks as spaces, the first space dropped, bytes that are no UTF-8 as U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
            else:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.names[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(MARK) and ids[0] not in self.bytes else text).replace(MARK, " ")

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for low in range(0, len(words), TOGETHER):
            part = words[low : low + TOGETHER]
            rows, ids, begin, count = self.columns.encode(part, self.pairs)
            each = dict(zip(rows.tolist(), np.split(ids, begin[1:]), strict=True)) if len(rows) else {}
            out += [each[i].tolist() if i in each else self.encode_word(w) for i, w in enumerate(part)]
        return out

    def _learn(self, words: set[str]) -> None:
        """See to it that ``young`` holds these words: number of ids, ids as text, and what they decode to."""
        if len(self.young) >= WORDS_KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for w in words - young.keys():
            got = old.get(w)
            if got is None:
                new.append(w)
            else:
                young[w] = got
        for low in range(0, len(new), TOGETHER):
            part = new[low : low + TOGETHER]
            rows, ids, begin, count = self.columns.encode(part, self.pairs)
            told, names = self.ids_told[ids].tolist(), self.pieces[ids].tolist()
            for r, a, n in zip(rows.tolist(), begin.tolist(), count.tolist(), strict=True):
                w, b = part[r], a + n
                text = "".join(names[a:b])
                young[w] = (n, ",".join(told[a:b]), w if text == w else text)  # one string instead of two
            for w in part if len(rows) < len(part) else ():
                if w not in young:
                    ids = self.encode_word(w)
                    # decode() drops the mark that a text begins with; a word's is put back
                    text = MARK + self.decode(ids) if ids[0] not in self.bytes and w[0] == MARK else self.decode(ids)
                    young[w] = (len(ids), ",".join(map(str, ids)), text)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self._cut(t) for t in texts]
        words = list(set().union(*cut))
        known = dict(zip(words, self.encode_words(words), strict=True))
        return [[i for w in part for i in known[w]] for part in cut]

    def _cut(self, text: str | None) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def forget(self) -> None:
        """Leave a worker that waits for its next task without words."""
        self.young, self.old = {}, {}

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, and SHA-256 of the ids as text and of the decoded text."""
        cut = [self._cut(t) for t in texts]
        self._learn(set().union(*cut))
        known, out = self.young, []
        for words in cut:
            n, told, parts = zip(*map(known.__getitem__, words), strict=True) if words else ((), (), ())
            decoded = "".join(parts)
            decoded = (decoded[1:] if decoded[:1] == MARK else decoded).replace(MARK, " ")
            out.append((sum(n), _sha(",".join(told)), _sha(decoded)))
        return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_models: dict[str, PieceModel] = {}


def model_at(key: str, data: bytes) -> PieceModel:
    """The model, built once in a Python worker."""
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids. The model file, under 1 MB, is read on the driver and goes to the tasks."""
    data = _model_bytes(model_path)
    key = hashlib.sha256(data).hexdigest()

    def run(batches):
        model = model_at(key, data)
        for b in batches:
            ids = [i for part in parts_of(column(b, "text"), BATCH_CHARS) for i in model.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of ``encode``."""
    data = _model_bytes(model_path)
    key = hashlib.sha256(data).hexdigest()

    def run(batches):
        model = model_at(key, data)
        for b in batches:
            texts = [model.decode(i) if i else "" for i in column(b, "ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded, in one pass."""
    data = _model_bytes(model_path)
    key = hashlib.sha256(data).hexdigest()

    def run(batches):
        model = model_at(key, data)
        for b in batches:
            got = [g for part in parts_of(column(b, "text"), BATCH_CHARS) for g in model.digests(part)]
            n, ids, texts = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        if key in _models:
            _models[key].forget()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
