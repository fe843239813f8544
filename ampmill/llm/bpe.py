"""Problem 6: encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: a piece's bytes are mapped one to one to Latin-1 characters, so that pyahocorasick (which
works on str) finds every vocabulary token at every byte position in one pass. The piece is then
cut by backtracking from longest matches: a token may follow another only if BPE merging would
leave the boundary between the two in place. That test depends on the two tokens alone and is
memoised, so a piece is encoded in time linear in its length, with exactly the ids of merging.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pre-tokeniser pattern published with this vocabulary.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept of each worker's memo of pieces and of token pairs; only speed depends on it.
MEMO_ENTRIES = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to ids; marker-like strings are ordinary text, None and '' give no ids."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        latin = lambda s: "".join(chr(alphabet[c]) for c in s)
        ids = {latin(s): i for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        self.whole = {s.encode("latin-1"): i for s, i in ids.items()}
        self.size = {i: len(s) for s, i in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for order, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = ids[latin(a)], ids[latin(b)]
            self.rank[left, right] = order
            self.parts.setdefault(ids[latin(a) + latin(b)], (left, right))
        self.order = {t: self.rank[p] for t, p in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            # tokens that merging can't reach never occur in its output
            if len(s) == 1 or i in self.parts:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECE_PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}

    def _survives(self, a: int, b: int, before: float) -> bool:
        """Whether the boundary between the tokens a and b outlives all merges up to the order before.

        Unmerge both in reverse order of their making; at each moment the two tokens that touch the
        boundary must not be a pair that merges before the later of the two was made. At equal order
        the leftmost occurrence merges first: a part on the left counts before, one on the right after.
        """
        order, parts, rank = self.order, self.parts, self.rank
        while True:
            r = rank.get((a, b))
            if r is not None and r < before:
                return False
            ra, rb = order.get(a, -1), order.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]

    def _fits(self, left: int, right: int) -> bool:
        known = self.fits_memo.get((left, right))
        if known is None:
            known = self._survives(left, right, float("inf"))
            if len(self.fits_memo) >= MEMO_ENTRIES:
                self.fits_memo.clear()
            self.fits_memo[left, right] = known
        return known

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token itself: its last merge must come last."""
        known = self.fits_memo.get((token, -1))
        if known is None:
            left, right = self.parts.get(token, (-1, -1))
            known = left >= 0 and all(p not in self.parts or self._reachable(p) for p in (left, right)) and self._survives(left, right, self.order[token])
            self.fits_memo[token, -1] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        known = self.whole.get(data)
        if known is not None and (len(data) == 1 or self._reachable(known)):
            return [known]
        n = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            starts[end - size + 1].append((size, token))
        # tokens that end later come later: the longest is the last
        out: list[int] = []
        choice: list[int] = []  # per token of out, the index of its match in starts
        dead = bytearray(n + 1)
        at, k = 0, len(starts[0]) - 1
        fits = self._fits
        while at < n:
            found = False
            here = starts[at]
            while k >= 0:
                size, token = here[k]
                if not dead[at + size] and (not out or fits(out[-1], token)):
                    found = True
                    break
                k -= 1
            if found:
                out.append(token)
                choice.append(k)
                at += size
                if at < n:
                    k = len(starts[at]) - 1
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.size[token]
                k = choice.pop() - 1
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo, encode_piece = self.memo, self.encode_piece
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = encode_piece(piece)
                if len(piece) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row of docs.

    Null and empty texts have an empty list; repeated rows are kept; other columns are ignored.
    A narrow map without shuffle: the plan is one scan of two columns and one Arrow map.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # an output batch is closed by tokens, so that very long texts don't add up in memory
            done, offsets, flat, total = 0, [0], [], 0
            for i in range(len(texts)):
                got = enc.encode(texts[i].as_py())
                flat.append(np.array(got, dtype=np.int32))
                total += len(got)
                offsets.append(total)
                if total > 2_000_000 or i + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids.slice(done, i + 1 - done), lists], names=["id", "ids"])
                    done, offsets, flat, total = i + 1, [0], [], 0

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), True))])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).toDF(id_col, "ids")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens int) for every row of docs, by the same encoder; null and empty texts have 0."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            counts = [len(enc.encode(texts[i].as_py())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["id", "n_tokens"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.IntegerType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).toDF(id_col, "n_tokens")
