"""BPE encoding and decoding by a pair occurrence index (operator 1).

The distinct words of a batch are laid out in one symbol sequence. An index maps each
mergeable pair, by its rank, to all its positions; the active ranks leave a heap in
ascending order; each merge rewrites its positions and adds the pairs that it creates to
their lists. All words that share a pair are merged in the same visit.

Null texts count as empty (no ids, decoded text ""). Texts of any length are encoded whole.
Repeated rows are encoded each, an empty table gives an empty one, and columns of the table that
are named like the result are replaced.

Words of ASCII, of Latin or of Cyrillic letters are split here; all others by the library's own
pre-tokenizer, so that its Unicode tables count and not Python's.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import add_columns, sub_batches, text_bytes, tokenizer_path

#: Fixed value: the pre-tokenization pattern of byte-level BPE files, for ASCII.
PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Letters of which every Unicode version since 4.0 says so, that are in NFC and have one lower-case letter.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u04ff]+")
#: Pieces between which no pre-token of PATTERN reaches, if the only white space is ASCII.
CHUNKS = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: First bytes of the white space beyond ASCII in UTF-8; their absence is quick to see.
MAYBE_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Punctuation that PATTERN splits from a word before it.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
#: Most entries and bytes (of keys and ids) that a generation of a memo takes before the next one begins.
MEMO_ENTRIES, MEMO_BYTES = 120_000, 16 << 20
#: Bytes of the longest piece that is remembered: longer ones hardly come again and would push out the others.
MEMO_PIECE = 64


def chunks(text: bytes) -> list[bytes]:
    """Pieces of a text that can be encoded one by one."""
    return [text] if MAYBE_WIDE.search(text) else CHUNKS.findall(text)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def of_letters(word: bytes) -> bool:
    return word.isalpha() or not word.isascii() and LETTERS.fullmatch(word.decode()) is not None


class Memo:
    """A dict in two generations, bounded by entries and bytes: what was used lately stays."""

    def __init__(self, entries: int = MEMO_ENTRIES, most: int = MEMO_BYTES):
        self.entries, self.most, self.size, self.new, self.old = entries, most, 0, {}, {}

    def add(self, keys: list[bytes], ids: list[bytes]) -> None:
        self.new.update(zip(keys, ids, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, ids))

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """The keys that are in neither generation; the others are in `new` afterwards."""
        if len(self.new) > self.entries or self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        absent = keys.difference(self.new)
        again = list(absent.intersection(self.old))
        self.add(again, list(map(self.old.__getitem__, again)))
        return list(absent.difference(again))

    @contextmanager
    def holding(self, keys: set[bytes], learned: Callable[[list[bytes]], list[bytes]]) -> Iterator[dict[bytes, bytes]]:
        """A dict with all `keys`; `learned` gives the ids of new ones. Keys over MEMO_PIECE are forgotten again after."""
        absent = self.missing(keys)
        if long := [k for k in absent if len(k) > MEMO_PIECE]:
            absent = [k for k in absent if len(k) <= MEMO_PIECE]
        made = learned([*absent, *long])
        self.add(absent, made[: len(absent)])
        self.new.update(zip(long, made[len(absent) :], strict=True))
        try:
            yield self.new
        finally:
            for k in long:
                self.new.pop(k, None)


class PairIndex:
    """Merge ranks of a byte-level BPE vocabulary, applied to many words at once."""

    def __init__(self, model: dict):
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-level BPE model")
        vocab: dict[str, int] = model["vocab"]
        symbols, suffix = byte_symbols(), model.get("end_of_word_suffix") or ""
        self.of_byte = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        #: the symbol of a word's last byte
        self.of_last = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        rank: dict[int, int] = {}  # (left << 20 | right) -> rank
        #: rank -> (left, right, merged)
        self.merge: list[tuple[int, int, int]] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = vocab[a], vocab[b]
            rank.setdefault(left << 20 | right, r)
            self.merge.append((left, right, vocab[a + b]))
        pairs = sorted(rank.items())
        self.pairs = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        #: the rank of each pair of bytes (a last byte is 256 more, no byte 512), so that a new sequence needs no search
        codes = np.r_[self.of_byte, self.of_last, -1]
        self.first_rank = self.ranks_of(np.repeat(codes, 513), np.tile(codes, 513)).astype(np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it is no merge or touches a word's edge."""
        pair = left.astype(np.int64) << 20 | right
        i = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[i] == pair), self.pair_rank[i], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, little-endian bytes) of each word, by one pair index over all of them."""
        if not words:
            return []
        ids, stop = self.encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        return [ids[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def encode_bytes(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids (int32, little-endian bytes) of the words that lie in `raw` one after the other, and where each word's ids end."""
        ends = np.cumsum(lengths + 1)
        seq = np.full(int(ends[-1]) + 1, -1, np.int32)  # a -1 stands before, between and after words
        inside = np.ones(len(seq), bool)
        inside[0] = False
        inside[ends] = False
        code = np.full(len(seq), 512, np.int32)
        code[inside] = raw
        code[ends[lengths > 0] - 1] += 256
        seq[inside] = np.r_[self.of_byte, self.of_last][code[inside]]
        before = np.arange(-1, len(seq) - 1)
        after = np.arange(1, len(seq) + 1)
        at: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            """Add the mergeable ones of `places` to their ranks' lists."""
            known = np.flatnonzero(ranks >= 0)
            if not len(known):
                return
            order = known[np.argsort(ranks[known], kind="stable")]
            sorted_ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(sorted_ranks[1:] != sorted_ranks[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for r, i, j in zip(sorted_ranks[begin].tolist(), begin, [*begin[1:], len(places)], strict=True):
                if r in at:
                    at[r].append(places[i:j])
                else:
                    at[r] = [places[i:j]]
                    heapq.heappush(active, r)

        ranks = self.first_rank[code[:-1] * 513 + code[1:]]
        del code, inside  # as long as the texts
        enter(np.arange(len(seq) - 1), ranks)
        del ranks
        while active:
            now = heapq.heappop(active)
            left, right, made = self.merge[now]
            lists = at.pop(now)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            p = p[seq[p] == left]
            q = after[p]
            fits = seq[q] == right
            if not fits.all():
                p, q = p[fits], q[fits]
            if left == right:
                p = self.apart(np.unique(p), after)
                q = after[p]
            if not len(p):
                continue
            seq[p], seq[q] = made, -2
            n = after[q]
            after[p], before[n] = n, p
            back = before[p]
            places = np.concatenate((back, p))
            enter(places, self.ranks_of(seq[places], seq[np.concatenate((p, n))]))
        keep = seq >= 0
        return seq[keep].astype("<i4").tobytes(), np.cumsum(keep)[ends] * 4

    @staticmethod
    def apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For a pair of equal symbols: of places that overlap, every other one from the left."""
        chained = after[places[:-1]] == places[1:]
        if not chained.any():
            return places
        new = np.r_[True, ~chained]
        first = np.flatnonzero(new)
        nth = np.arange(len(places)) - first[np.cumsum(new) - 1]
        return places[nth % 2 == 0]


class PairIndexEncoder:
    """A byte-level BPE file: pre-tokens, special tokens and a pair index."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if spec["normalizer"] or spec["pre_tokenizer"] != plain:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.index = PairIndex(spec["model"])
        back = self.back = {c: b for b, c in byte_symbols().items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content
        self.pre_tokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.memo = Memo()

    def learned(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        split = [self.words(p) for p in pieces]
        words = list(set(chain.from_iterable(split)))
        ids = dict(zip(words, self.index.encode_words(words), strict=True))
        return [b"".join([ids[w] for w in ws]) for ws in split]

    def words(self, piece: bytes) -> list[bytes]:
        """The pre-tokens of a piece; letters, with a mark after them or without, need no pattern."""
        letters = piece[1:] if piece[:1] == b" " else piece
        if of_letters(letters):
            return [piece]
        if letters[-1:] in MARKS and of_letters(letters[:-1]):
            return [piece[:-1], piece[-1:]]
        if piece.isascii():
            return PATTERN.findall(piece)
        return [bytes(map(self.back.__getitem__, token)) for token, _ in self.pre_tokens(piece.decode())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        out: list[bytes] = []
        for run in sub_batches(texts):
            parts = []
            for text in run:
                if self.at_special and self.at_special.search(text):
                    parts.append([x for s in self.at_special.split(text) for x in ([s] if s in self.special else chunks(s))])
                else:
                    parts.append(chunks(text))
            distinct = set().union(*parts)
            with self.memo.holding(distinct.difference(self.special), self.learned) as known:
                for s in self.special.keys() & distinct:
                    known[s] = np.array([self.special[s]], "<i4").tobytes()
                get = known.__getitem__
                out += [b"".join(map(get, p)) for p in parts]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD; unknown ids give nothing."""
        table, n = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids.tolist() if 0 <= i < n]).decode("utf-8", "replace")


@cache
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def list_array(parts: list[bytes]) -> pa.Array:
    """Arrow lists of int32 from raw bytes of each row."""
    flat = b"".join(parts)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4, out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` with `ids_col` array<int>: the whole text's ids, no special tokens added."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def start():
        enc = encoder(path)
        return lambda text: [list_array(enc.encode(text.to_pylist()))]

    return add_columns(docs, [text_bytes(text_col)], T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))]), start)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with `text_col`: the text of its ids (null ids: empty)."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def start():
        enc = encoder(path)

        def step(ids: pa.Array) -> list[pa.Array]:
            flat = ids.values.to_numpy(zero_copy_only=False)
            bounds = ids.offsets.to_numpy()
            return [pa.array([enc.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())]

        return step

    ids = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return add_columns(df, [ids], T.StructType([T.StructField(text_col, T.StringType())]), start)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = decode(encode(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
