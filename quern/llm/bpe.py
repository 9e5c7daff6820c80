"""Byte-level BPE encoding and decoding; long texts are encoded as a tree of halves whose joins are re-encoded in growing windows."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import drop_saved, give_back, save, table

#: Texts of more characters are halved until no part is longer.
LEAF = 16_384
#: Texts of more characters are dealt out over tasks, in parts of no more; so many neighbouring parts are joined at a time.
SPLIT, FAN = 1 << 20, 8
#: Characters given to the encoder at once, and tokens on each side of a join in its first window.
AT_ONCE, FIRST_WINDOW = 1 << 19, 8


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Bpe:
    """A vocabulary file of the tokenizers library, byte-level, and its decoding table."""

    path: str
    tokenizer: Tokenizer = field(init=False)
    specials: list[str] = field(init=False)

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        with open(self.path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        pieces = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in vocab.items():
            if i not in added:
                pieces[i] = bytes(byte[c] for c in token)
        for i, token in added.items():
            pieces[i] = token.encode()
        self.specials = list(added.values())
        self.lens = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.table = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            out += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def cuts(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        """Ends of the leaves of text[lo:hi], halved until none is longer than ``leaf``; never within a special token."""
        if hi - lo <= leaf:
            return [hi]
        mid = (lo + hi) // 2
        for s in self.specials:
            p = text.find(s, max(lo, mid - len(s) + 1), min(hi, mid + len(s) - 1))
            if lo < p < mid < p + len(s):
                mid = p
        return self.cuts(text, lo, mid, leaf) + self.cuts(text, mid, hi, leaf)

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Encoding of two texts together, from theirs.

        A window reaches from a token's start in the left one to a token's end in the right one. Its own encoding
        takes the place of theirs if it begins with that left token and ends with that right token: then all
        neighbouring tokens are neighbours in an encoding of one text, and such a sequence is the encoding of the
        whole. Otherwise the window grows, at last to both texts. Ends at which the splitting into words could hang
        on what the window leaves out (within a character, at an apostrophe, after white space) are passed over.
        """
        (a, ia), (b, ib) = left, right
        k = FIRST_WINDOW
        while True:
            na, nb = self._back(a, ia, k), self._ahead(b, ib, k)
            cut_a = len(a) - int(self.lens[ia[len(ia) - na :]].sum())
            cut_b = int(self.lens[ib[:nb]].sum())
            window = self.batch([(a[cut_a:] + b[:cut_b]).decode()])[0]
            same_a = na == len(ia) or (len(window) > 1 and window[0] == ia[len(ia) - na])
            same_b = nb == len(ib) or (len(window) > 1 and window[-1] == ib[nb - 1])
            if same_a and same_b:
                return a + b, np.concatenate([ia[: len(ia) - na], window, ib[nb:]])
            k *= 2

    def _back(self, a: bytes, ids: np.ndarray, k: int) -> int:
        """Tokens to go back from the end: k, or more for a fit place to cut; all if there is none."""
        at = len(a) - np.cumsum(self.lens[ids[::-1]][: k + 64]) if k < len(ids) else np.empty(0, np.int64)
        for n in range(k, min(len(ids), len(at))):
            p = int(at[n - 1])
            if a[p] & 0xC0 != 0x80 and a[p] != 0x27:
                return n
        return len(ids)

    def _ahead(self, b: bytes, ids: np.ndarray, k: int) -> int:
        at = np.cumsum(self.lens[ids[: k + 64]]) if k < len(ids) else np.empty(0, np.int64)
        for n in range(k, min(len(ids), len(at))):
            p = int(at[n - 1])
            if p < len(b) and b[p] & 0xC0 != 0x80 and b[p - 1] < 0x80 and not chr(b[p - 1]).isspace() and 0x27 not in b[max(0, p - 3) : p]:
                return n
        return len(ids)

    def tree(self, text: str, leaf: int = LEAF) -> np.ndarray:
        ends = self.cuts(text, 0, len(text), leaf)
        parts = [text[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        nodes = list(zip([p.encode() for p in parts], self.batch(parts), strict=True))
        while len(nodes) > 1:
            pairs = [self.join(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = pairs + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][1]

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= leaf]
        for i, ids in zip(short, self.batch([texts[i] for i in short]), strict=True):
            out[i] = ids
        return [self.tree(t, leaf) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """All tokens' bytes in a row, special tokens too; bytes that are not UTF-8 become U+FFFD."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.table[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str | None = None, text_col: str = "text", leaf: int = LEAF, decoded: bool = True, write: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (array of int) and decoded (the text that the ids give back).

    Equal to the tokenizers library's encoding of each whole text with add_special_tokens=False, and its decoding
    with skip_special_tokens=False. Texts of more than SPLIT characters are dealt out: their parts are rows of their
    own, encoded by as many tasks, and joined FAN at a time until one is left. Null and empty texts have no tokens and
    decode to the empty text. Repeated rows and other columns stay (columns of these three names are replaced). No
    rows give no rows. The result is a table in the shared folder, unless ``write`` is false: then it is computed by
    whoever reads it. Without ``decoded`` the column is left out, and that the ids give the text back is checked.
    """
    path = path or default_vocabulary()
    if decoded:
        return _mapped(docs, text_col, path, leaf, "n_tokens long, ids array<int>, decoded string", _ids, write)
    return _mapped(docs, text_col, path, leaf, "n_tokens long, ids array<int>", _checked, write)


def bpe_digests(docs: DataFrame, path: str | None = None, text_col: str = "text", leaf: int = LEAF, keep: list[str] | None = None) -> DataFrame:
    """As bpe_encode(), but with digests of ids and decoded text in place of both: ids_sha256, decoded_sha256; of the columns of ``docs`` those in ``keep``, all by default."""
    return _mapped(docs, text_col, path or default_vocabulary(), leaf, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, keep=keep)


def _ids(bpe: Bpe, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
    return [*_only_ids(ids), pa.array([bpe.decode(x) for x in ids], pa.string())]


def _only_ids(ids: list[np.ndarray]) -> list[pa.Array]:
    flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return [pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))]


def _checked(bpe: Bpe, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
    for text, own in zip(texts, ids, strict=True):
        if bpe.decode(own) != text:
            raise ValueError(f"a text of {len(text)} characters doesn't come back from its {len(own)} ids")
    return _only_ids(ids)


def _digests(bpe: Bpe, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
    ]


def _parts(path: str):
    """Rows row, text: the parts of each text, numbered; none is longer than SPLIT, none cuts a special token."""
    limit = SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py()
                ends = bpe.cuts(text, 0, len(text), limit)
                for i, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([i], pa.int64()), pa.array([text[x:y]], pa.string())], ["row", "part", "text"])

    return run


def _leaves(path: str, leaf: int):
    """Rows row, part, text: each part's bytes and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for row, part, value in zip(*(batch.column(c) for c in range(3)), strict=True):
                text = value.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([part.as_py()], pa.int64()), pa.array([text.encode()], pa.binary()), pa.array([bpe.tree(text, leaf).tobytes()], pa.binary())], ["row", "part", "bytes", "ids"])
        give_back()

    return run


def _joins(path: str):
    """Rows row, up, part, bytes, ids, those of a (row, up) standing together in order: one row for each, joined pair by pair."""
    def joined(bpe: Bpe, row: int, up: int, nodes: list) -> pa.RecordBatch:
        while len(nodes) > 1:
            pairs = [bpe.join(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = pairs + nodes[len(nodes) - len(nodes) % 2 :]
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([up], pa.int64()), pa.array([nodes[0][0]], pa.binary()), pa.array([nodes[0][1].tobytes()], pa.binary())], ["row", "part", "bytes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last, held = vocabulary(path), None, []
        for batch in batches:
            for row, up, text, ids in zip(*(batch.column(c) for c in (0, 1, 3, 4)), strict=True):
                name = (row.as_py(), up.as_py())
                if held and name != last:
                    yield joined(bpe, *last, held)
                    held = []
                last = name
                held.append((text.as_py(), np.frombuffer(ids.as_py(), dtype=np.uint32)))
        if held:
            yield joined(bpe, *last, held)
        give_back()

    return run


def _long_ids(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """(row, ids as bytes) of long texts (row, __text): parts across tasks, then joins of FAN neighbours, level by level, each level written."""
    spark = long.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = long.select("row", "__text").mapInArrow(_parts(path), "row long, part long, text string")
    level = save(parts.repartition(tasks, "row", "part").mapInArrow(_leaves(path, leaf), "row long, part long, bytes binary, ids binary"), "bpe-level")
    while level.where("part > 0").limit(1).count():
        above = level.select("row", F.floor(F.col("part") / FAN).alias("up"), "part", "bytes", "ids")
        grouped = above.repartition(tasks, "row", "up").sortWithinPartitions("row", "up", "part")
        level, below = save(grouped.mapInArrow(_joins(path), "row long, part long, bytes binary, ids binary"), "bpe-level"), level
        drop_saved(below)
    return level.select("row", F.col("ids").alias("__ids"))


def _mapped(docs: DataFrame, text_col: str, path: str, leaf: int, added: str, make, write: bool = True, keep: list[str] | None = None) -> DataFrame:
    new = [x.split()[0] for x in added.split(", ")]
    docs = docs.select(*[c for c in docs.columns if c not in new or c == text_col])
    keep = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    inner = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            if "__ids" in batch.schema.names:
                ids = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("__ids").to_pylist()]
            else:
                ids = bpe.encode(texts, leaf)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *make(bpe, texts, ids)], [*keep, *new])
        give_back()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep], added])
    out = inner.where(F.length("__text") <= SPLIT).mapInArrow(run, schema)
    long = save(inner.where(F.length("__text") > SPLIT).withColumn("__row", F.monotonically_increasing_id()), "bpe-long")
    if long.limit(1).count():
        ids = _long_ids(long.select(F.col("__row").alias("row"), "__text"), path, leaf).withColumnRenamed("row", "__row")
        out = out.unionByName(long.join(ids, "__row").mapInArrow(run, schema))
    return save(out, "bpe") if write else out


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
