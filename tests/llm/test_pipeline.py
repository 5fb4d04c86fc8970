import re

import numpy as np
import public_tokenizers
from tests.llm.fixtures import table
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from leafsieve.llm.quality import measure

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The documents before packing, by plain loops (the quality verdict is tested by itself)."""
    kept = [r for r in rows if measure([(r["text"] or "").encode()]).kept[0]]
    groups = {}
    for r in kept:
        groups.setdefault(re.sub("[ \t-\r]", "", r["text"]), []).append(r)
    kept = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]
    first = brute_components([r["doc_id"] for r in kept], [brute_print(r["text"]) for r in kept])
    out = {}
    for r in kept:
        if first[r["doc_id"]] != r["doc_id"]:
            continue
        text, merged = r["text"], []
        for start, _, stop, kind in brute_spans(text):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop, kind])
        for start, stop, kind in reversed(merged):
            text = f"{text[:start]}<{kind.upper()}>{text[stop:]}"
        out[r["doc_id"]] = text
    return out


def test_run_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, tok = brute(rows), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(got) == set(want)
    for i, pieces in got.items():
        ids = np.frombuffer(b"".join(p for _, p in sorted(pieces)), "<u4").tolist()
        assert ids == tok.encode(want[i], add_special_tokens=False).ids + [1]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    odd = table(spark, [None, "", "word " * 20])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
