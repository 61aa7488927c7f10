"""Byte-level BPE by backtracking over longest token matches.

An Aho-Corasick automaton over the vocabulary gives, for every place of a piece, the
longest token that begins there. The encoder takes the longest match and keeps it if the
pair of the last token and this one is compatible, that is, if merging by rank would leave
that boundary alone; otherwise it tries the next shorter token, and steps back where none
is left. Places found to be dead ends are marked, so the work is linear in the text, and
the result is exactly that of merging pairs by rank. Decoding gathers bytes from one blob
of all tokens through an offset table.

Texts are first cut by the vocabulary's own pattern; pieces that recur within a task are
remembered (short ones, in a bounded memory, without effect on results).

Defined results: a null text is encoded as an empty one; an empty text has no tokens; the
special token's own string is one token, as the library has it; very long texts are encoded
whole; repeated rows are encoded one by one; any other column passes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import bounded_batches, parts, read

#: Pieces of text that a process remembers in each of two generations, their characters at most; and pairs of tokens.
MEMORY, LONGEST, PAIRS = 150_000, 64, 400_000
#: How texts are cut before merging (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODED = T.StructType([T.StructField("ids", T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False)])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by rule:
    printable Latin-1 letters stand for themselves, the other bytes follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """Pieces and their token ids as little-endian bytes, in two generations.

    Each holds ``MEMORY`` pieces of at most ``LONGEST`` characters, whatever texts are met.
    """

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.encode(piece.encode("utf-8"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:  # what hasn't been met since the last time is forgotten
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.n = max([*tokens, *self.special.values()]) + 1
        self.id_of = {b: i for i, b in tokens.items()}
        #: Ranks order the merges; single bytes come before all of them.
        self.rank: dict[int, int] = {i: -1 for i, b in tokens.items() if len(b) == 1}
        self.pair_token: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            t = self.id_of[a + b]
            self.pair_token[self.id_of[a], self.id_of[b]] = t
            if t in self.parts:
                raise ValueError("a token has two derivations, but each is taken apart in one way")
            self.parts[t] = self.id_of[a], self.id_of[b]
            self.rank[t] = r
        self.length, self.shorter = [0] * self.n, [-1] * self.n
        for i, b in tokens.items():
            self.length[i] = len(b)
            self.shorter[i] = next((self.id_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.id_of), -1)
        self.trie = ahocorasick.Automaton()
        for i, b in tokens.items():
            self.trie.add_word(b.decode("latin-1"), i)
        self.trie.make_automaton()
        self.compatible: dict[int, bool] = {}
        every = tokens | {i: s.encode() for s, i in self.special.items()}
        sizes = [len(every.get(i, b"")) for i in range(self.n)]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(every.get(i, b"") for i in range(self.n)), np.uint8)
        self._cut = regex.compile(PATTERN).findall
        # Letters and digits newer than Unicode 15.1 are unknown to the library's own cutter.
        known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000)))))
        self.newer = {x for x in known if unicodedata.category(x) == "Cn"}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda s: [s]
        self.memory = Memory(self.encode_piece)

    def stays(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between tokens a and b alone.

        The two tokens are taken apart from the latest merge back; if, on the way, the two
        parts at the boundary could have merged earlier than what was taken apart, then
        they would have.
        """
        x, y, rank = a, b, self.rank
        limit = (1 << 40, 0)  # merges at the boundary must come before this (rank, side)
        out = None
        while out is None:
            joined = self.pair_token.get((x, y))
            if joined is not None and (rank[joined], 0) < limit:
                out = False
            elif rank[x] < 0 and rank[y] < 0:
                out = True
            elif rank[x] > rank[y]:
                # Of equal ranks the left place merges first, so a tie goes to the left token.
                limit, x = (rank[x], 0), self.parts[x][1]
            else:
                limit, y = (rank[y], 1), self.parts[y][0]
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[a * self.n + b] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        n, size = len(piece), self.n
        length, shorter, known = self.length, self.shorter, self.compatible.get
        longest = [-1] * n
        for end, token in self.trie.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # longer matches of a start come later
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        break
                    stays = known(last * size + token)
                    if self.stays(last, token) if stays is None else stays:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("a byte has no token")
                alive[at] = 0
                out.pop()
                at -= length[last]
                token = last  # its end is dead now, so a shorter one is taken
        return out

    def cut(self, text: str) -> list[str]:
        """Pieces within which tokens are merged."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if not self.newer.isdisjoint(text):
                    from tokenizers import pre_tokenizers

                    return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return self._cut(text)

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get = self.memory.__getitem__
        if not any(s in text for s in self.special):
            return b"".join(map(get, self.cut(text)))
        out = []
        for part in self.split(text):
            out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else b"".join(map(get, self.cut(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of these ids; malformed bytes become U+FFFD."""
        t = np.frombuffer(ids, "<u4")
        if not len(t):
            return b""
        first = self.offsets[t]
        size = self.offsets[t + 1] - first
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return self.blob[place].tobytes().decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each process and vocabulary."""
    return Codec(path)


def encoder(path: str):
    """A function of a text column: struct of ids (little-endian) and n_tokens."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in parts(batches):
            ids = [c.encode(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["ids", "n_tokens"])

    return F.arrow_udf(encode, ENCODED).asNondeterministic()


def decoder(path: str):
    """A function of a column of such ids: the text."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for ids in parts(batches):
            yield pa.array([None if x is None else c.decode(x).decode("utf-8") for x in ids.to_pylist()], pa.string())

    return F.arrow_udf(decode, T.StringType())


def tokenise(docs: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, encoder(path or default_vocabulary())(F.col(text)))


def _round_trip(path: str):
    """Both directions in one visit of the text; the decoded text is not kept, but its digest."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in parts(batches):
            n, ids, back = [], [], []
            for t in texts.to_pylist():
                x = c.encode(t)
                n.append(len(x) // 4)
                ids.append(sha(x))
                back.append(sha(c.decode(x)))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(run, kind).asNondeterministic()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", _round_trip(default_vocabulary())("text").alias("t")).select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: each document's tokens, and digests that show the round trip."""
    bounded_batches(spark)
    path = default_vocabulary()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in parts(batches):
            ids = [c.encode(t) for t in texts.to_pylist()]
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
            same = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, flat), same], names=["ids", "decoded_sha256"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded_sha256", T.StringType())])
    encode = F.arrow_udf(run, kind).asNondeterministic()
    rows = docs.select("doc_id", "source", "lang", encode("text").alias("t"))
    return rows.select("doc_id", "source", "lang", F.size("t.ids").cast("long").alias("n_tokens"), F.col("t.ids").alias("ids"), F.col("t.decoded_sha256").alias("decoded_sha256"))
