"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A text is cut into pieces by the tokenizer's pattern. In a piece, the longest token that starts at a position (from
an Aho-Corasick automaton's trie over all tokens) is tried first and kept only if the pair of it and the token before
it is compatible: encoding the two tokens' joined bytes by the merge rules gives back just these two. If no shorter
prefix token fits either, the last token is taken back. A sequence whose neighbours are all compatible is the one
that the merge rules give, so results are exact; each position is closed at most once, so the work is linear.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm import latin
from rankspark.llm.common import make_room, per_worker, replace_columns, require, trim, with_fields

#: The published byte-level pattern, for any text and for Latin text, and the bytes that stand for
#: themselves in its alphabet.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{latin.LETTERS}]+| ?[{latin.NUMBERS}]+| ?[^{latin.SPACES}{latin.LETTERS}{latin.NUMBERS}]+|[{latin.SPACES}]+(?![^{latin.SPACES}])|[{latin.SPACES}]+"
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: A worker keeps the ids of so many pieces at most.
CACHED = 200_000
PAIRS = 400_000


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte; bytes that aren't visible follow from code point 256 on."""
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    return {chr(b): b for b in VISIBLE} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers, encoded at the first look."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.encode(piece.encode("utf-8")), "<u4").tobytes()
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = {t: i for t, i in model["vocab"].items() if t not in self.special}
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.token = {i: to_bytes(t) for t, i in plain.items()}
        self.id_of = {b: i for i, b in self.token.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.parts = {}
        for (a, b), r in self.rank.items():
            self.parts.setdefault(a + b, (a, b, r))
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.reach = max(map(len, self.id_of), default=1)
        self.trie = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.trie.add_word(b.decode("latin-1"), i)
        self.trie.make_automaton()
        self.shorter = {i: self._shorter(b) for i, b in self.token.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache = Pieces(self.encode_piece)
        self.pattern, self.latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _shorter(self, b: bytes) -> int:
        """The longest token that is a proper prefix of b, or -1."""
        for n in range(len(b) - 1, 0, -1):
            if b[:n] in self.id_of:
                return self.id_of[b[:n]]
        return -1

    def merged(self, b: bytes) -> list[bytes]:
        """The merge rules themselves, on a short string: the lowest rank first, leftmost first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at a token's right or left end while it is being merged: each part with the rank of the merge
        that takes it up, the token itself with one that never comes."""
        known = self.spines.get((token, right))
        if known is None:
            known, part, until = [], self.token[token], 1 << 60
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                first, second, until = self.parts[part]
                part = second if right else first
            self.spines[token, right] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as pairs are met: no merge joins an end of a and a start of b before
        merges inside the tokens take up both. Of equal merges the left one comes first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            rank, known = self.rank.get, True
            for x, x_until in self._spine(a, True):
                for y, y_until in self._spine(b, False):
                    r = rank((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            self.pairs[a, b] = known
        return known

    def longest(self, s: str, at: int) -> int:
        """Id of the longest token that starts at a position of a Latin-1 view of bytes."""
        _, token = next(self.trie.iter_long(s[at : at + self.reach] if len(s) > self.reach else s[at:]))
        return token

    def encode_piece(self, b: bytes) -> list[int]:
        whole = self.id_of.get(b)
        if whole is not None and self.merged_whole(whole):
            return [whole]
        s, n, at, out = b.decode("latin-1"), len(b), 0, []
        closed = bytearray(n + 1)
        token = self.longest(s, 0) if n else -1
        while at < n:
            end = at + len(self.token[token])
            if not closed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = self.longest(s, at)
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                closed[at] = 1
                token = out.pop()
                at -= len(self.token[token])
        return out

    def merged_whole(self, token: int) -> bool:
        """Whether the merge rules make this token from its own bytes."""
        known = self.pairs.get((token, -1))
        if known is None:
            known = self.pairs[token, -1] = self.merged(self.token[token]) == [self.token[token]]
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the special tokens' strings become their ids, as the library's default has it."""
        trim(self.cache, CACHED)
        get = self.cache.__getitem__
        find = self.pattern.findall if latin.BEYOND.search(text) else self.latin.findall
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(b"".join(map(get, find(text))), "<u4")
        made = []
        for part in self.cut.split(text):
            made.append(np.uint32(self.special[part]).tobytes() if part in self.special else b"".join(map(get, find(part))))
        return np.frombuffer(b"".join(made), "<u4")


class OffsetTable:
    """All tokens' bytes in one blob, and where each begins: ids become bytes by one gather."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["id"]: t["content"].encode("utf-8") for t in spec.get("added_tokens", [])}
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special} | special
        size = max(tokens) + 1
        lengths = np.zeros(size, np.int64)
        for i, b in tokens.items():
            lengths[i] = len(b)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.length = lengths
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray, block: int = 1 << 20) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD. Unknown ids give nothing."""
        out = []
        for at in range(0, len(ids), block):
            part = ids[at : at + block].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.length))]
            n = self.length[part]
            ends = np.cumsum(n)
            if len(part) and ends[-1]:
                move = np.repeat(self.start[part] - (ends - n), n)
                out.append(self.blob[move + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array<int> column of token ids of every whole text.

    Null and empty texts give an empty array; other columns stay as they are, and one named like `ids` is replaced.
    tokenizer: path of the vocabulary, readable on every executor.
    """
    require(df, text)
    df = replace_columns(df, ids) if ids != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        bpe = per_worker(ByteBpe, tokenizer)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            done, total, made = 0, 0, []
            for k, t in enumerate(texts):
                made.append(bpe.encode(t) if t else np.zeros(0, "<u4"))
                total += len(made[-1])
                if total > 2_000_000 or k == len(texts) - 1:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).astype(np.int32)))
                    yield _with_column(batch.slice(done, len(made)), ids, values)
                    done, total, made = k + 1, 0, []

    return df.mapInArrow(run, with_fields(df.schema, f"`{ids}` array<int>"))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the string column that the ids stand for; special tokens are kept. Null ids give an empty string."""
    require(df, ids)
    df = replace_columns(df, text) if ids != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        table = per_worker(OffsetTable, tokenizer)
        for batch in batches:
            column = batch.column(ids)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            none = column.is_null().to_numpy(zero_copy_only=False)
            out = ["" if none[k] else table.decode(values[ends[k] : ends[k + 1]]) for k in range(len(column))]
            yield _with_column(batch, text, pa.array(out, pa.string()))

    return df.mapInArrow(run, with_fields(df.schema, f"`{text}` string"))


def round_trip_digests(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; per document its id, number of tokens, and SHA-256 of ids and decoded text."""
    both = decode(encode(df.select(doc_id, text), tokenizer, text).drop(text), tokenizer)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        F.col(doc_id), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
