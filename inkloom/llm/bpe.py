"""Encoding with a public byte-level BPE vocabulary: exact merges in linear time by backtracking.

Each piece of a text (by the vocabulary's pattern) is encoded left to right: take the longest token that
matches at the position; if it can't stand after the token before it, take the next shorter one; if none
can, give back the last token. Two tokens can stand together if merging their bytes gives them back,
which a pair-compatibility table answers. Longest matches of all positions come from one Aho-Corasick
pass. Pieces that are tokens themselves, and pieces met before, are looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Where the public tokenizers lie; a parameter of every entry point.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept for lookup in one worker, a bound on its memory.
CACHE = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Encoder and decoder of one vocabulary. ``ranks`` orders merges: a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(PATTERN).findall
        # For each token the longest token that is a proper prefix of it.
        self.shorter: dict[int, int] = {}
        for token, i in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (p := ranks.get(token[:n])) is not None:
                    self.shorter[i] = p
                    break
        # Merging undone: the last merge that makes each token, as the pair of lowest rank order.
        self.parts = {i: self._last_merge(t) for t, i in ranks.items()}
        self.merged = {parts: i for i, parts in self.parts.items() if parts[0] != i}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[bytes, list[int]] = {}
        self.match = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) > 1:
                self.match.add_word(token.decode("latin-1"), (len(token), i))
        self.match.make_automaton()
        self.single = [ranks[bytes([b])] for b in range(256)]

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge gives the token, by merging its bytes up to that step."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                return ranks[token], ranks[token]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (ranks[token], ranks[token])

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stand side by side in the encoding of their joined bytes.

        Walks their merges back from the last: a merge across the border that comes before both
        neighbours' own merges would have happened first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = self._compatible(a, b)
            if len(self.pairs) < 4 * CACHE:
                self.pairs[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        merged, parts = self.merged, self.parts
        limit = 1 << 60  # ids from here on merge later than what was undone last
        while merged.get((a, b), limit) >= limit:
            left, right = parts[a], parts[b]
            can_left, can_right = left[0] != a, right[0] != b  # single bytes can't be undone
            if not can_left and not can_right:
                return True
            # Undo the later merge; of equal ones the right one, as equal merges go from left to right.
            if can_left and (a > b or not can_right):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]
        return False

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        known = self.cache.get(data)
        if known is None:
            known = self._backtrack(data)
            if len(self.cache) < CACHE and len(data) < 256:
                self.cache[data] = known
        return known

    def _backtrack(self, data: bytes) -> list[int]:
        n = len(data)
        single = self.single
        longest = [single[b] for b in data]
        size = [1] * n
        for end, (length, i) in self.match.iter(data.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, i
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        out: list[int] = []
        pos = 0
        dead = bytearray(n + 1)  # positions from which no encoding goes on
        nxt: int | None = longest[0]
        while nxt is not None:
            token = nxt
            while True:
                end = pos + len(tokens[token])
                if not dead[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    nxt = longest[pos] if pos < n else None
                    break
                if token in shorter:
                    token = shorter[token]
                    continue
                dead[pos] = 1
                if not out:
                    raise ValueError("no encoding")
                nxt = out.pop()
                pos -= len(tokens[nxt])
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and empty texts. Lone surrogates become U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        for p in self.split(text):
            out += self.piece(p.encode("utf-8", "surrogatepass") if p.isascii() else p.encode("utf-8", "replace"))
        return out

    def offsets(self, ids: list[int]) -> list[int]:
        """Offset table: the byte at which each token begins, and the end."""
        table = [0]
        for i in ids:
            table.append(table[-1] + len(self.tokens[i]))
        return table

    def decode(self, ids: list[int]) -> str:
        """The text of ids, its bytes put at the places of the offset table."""
        table = self.offsets(ids)
        data = bytearray(table[-1])
        for at, i in zip(table, ids):
            data[at : at + len(self.tokens[i])] = self.tokens[i]
        return data.decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(load_ranks(path))
    return _LOADED[path]


def with_ids(texts: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``texts(text, ...)`` with ids in place of text (and of a column ids); the vocabulary file is read on each executor.

    Null and empty texts get an empty list; repeated rows stay.
    """
    texts = texts.drop("ids")
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield batch.set_column(batch.schema.get_field_index("text"), "ids", ids)

    schema = ", ".join("ids array<int>" if f.name == "text" else f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, schema)


def p7_ids(spark, folder: str) -> DataFrame:
    """(doc_id, ids): each document's ids by byte_bpe_50k, without special tokens."""
    return with_ids(runtime.spread(runtime.table(spark, folder, "documents").select("doc_id", "text")))
