import hashlib
import random
import struct

import numpy as np
from quern.llm.bpe import bpe_encode, default_vocabulary, op2_bpe, vocabulary
from tokenizers import Tokenizer


def texts():
    rng = random.Random(11)
    bits = ["the ", "tion", "'", "s", "'ll", "  ", "\n", "\t ", "é", "ß", "日本", "\U0001f600", "123", "--", "!!", "<|endoftext|>", "<|endo", "x", " ", "aaaa", "…", " ", "́"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 160))) for _ in range(300)]
    out += ["", "a" * 3000, " " * 3000, "é" * 1500, "\U0001f600" * 700, "<|endoftext|>" * 100, "'s" * 500, "abc'" * 400, "".join(rng.choice("abcdefgh") for _ in range(5000)), "".join(rng.choice("!?'-") for _ in range(3000)), "".join(rng.choice("  \n\tx") for _ in range(3000))]
    return out


def test_tree_equals_the_library():
    lib, bpe = Tokenizer.from_file(default_vocabulary()), vocabulary(default_vocabulary())
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        for leaf in (16, 53, 400):
            assert bpe.encode([t], leaf)[0].tolist() == want, (leaf, t[:80])
        assert bpe.decode(np.array(want, dtype=np.int64)) == lib.decode(want, skip_special_tokens=False) == t


def test_operator(spark, tmp_path):
    lib = Tokenizer.from_file(default_vocabulary())
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(100, None, None), (None, "abc", "y"), (1, "twice", "z"), (1, "twice", "z"), (207, "w " * 60_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(bpe_encode(df, leaf=64).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    for r, (i, t, _) in zip(got, sorted(rows, key=key), strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.ids, r.n_tokens, r.decoded) == (i, want, len(want), t or "")
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_bpe(spark, str(tmp_path)).where("doc_id >= 2 and doc_id < 40").collect():
        ids = lib.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest())
    assert bpe_encode(df.where("doc_id > 1000")).collect() == []


def test_long_texts_over_tasks(spark, monkeypatch):
    """Texts dealt out in parts and joined in levels; other columns, repeats and short texts as ever."""
    from quern.llm import bpe

    monkeypatch.setattr(bpe, "SPLIT", 50)
    monkeypatch.setattr(bpe, "FAN", 2)
    lib = Tokenizer.from_file(default_vocabulary())
    some = [t for t in texts() if len(t) > 300][:12] + texts()[-8:]
    rows = [(i, t, "r") for i, t in enumerate(some)] + [(500, "short", None), (501, None, None), (502, some[0], "again"), (502, some[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(bpe_encode(df, leaf=16).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text, r["row"]) for r in got] == rows
    for r in got:
        assert (r.ids, r.decoded) == (lib.encode(r.text or "", add_special_tokens=False).ids, r.text or "")
    plain = sorted(bpe_encode(df, leaf=16, decoded=False, write=False).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in plain] == [r.ids for r in got] and "decoded" not in plain[0].asDict()
