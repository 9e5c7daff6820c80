import os
import re

import pytest
from quern.llm.decontaminate import normalise
from test_minhash_dedup import brute
from test_spans import base_pii
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from quern.llm.bpe import default_vocabulary
    from quern.llm.common import save

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [normalise(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        cols = docs.columns
        docs = save(stage(spark, docs, DATA), "t")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if stage is cp.keep_quality:
            good = [i for i in before if labels.get(i) == 1]
            assert set(after) <= set(before) and sum(i in after for i in good) >= 0.95 * len(good)
            bad = [i for i in before if labels.get(i) == 0]
            assert sum(i not in after for i in bad) >= 0.6 * len(bad)
        elif stage is cp.keep_one_of_each:
            assert set(after) == {i for i, (_, c) in brute(before.items(), 5, 80, 100).items() if i == c}
        elif stage is cp.drop_benchmark:
            assert not any(x in normalise(r.text) for r in rows for x in items)
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in normalise(t) for x in items)}
        elif stage is cp.redact_personal_data:
            assert set(after) == set(before)
            for i, r in after.items():
                assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.", r.text) and r.n_chars == len(r.text)
                assert base_pii(before[i]) or r.text == before[i] or "[CARD]" in r.text or "[PHONE]" in r.text
        else:
            lib = Tokenizer.from_file(default_vocabulary())
            for r in rows:
                assert r.ids == lib.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
            cols = [*cols, "n_tokens", "ids"]
        assert docs.columns == cols
        kept[name] = len(rows)
    assert cp.run(spark, DATA).count() == len(rows)
