import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import small, table
from tokenizers import Tokenizer

from leafsieve.llm.queries import QUERIES
from leafsieve.llm.token_files import TokenFiles, read_index, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello big World", None, "", " \n", "repeat", "repeat", "w" * 5000, "日本語 é É ×", "<|endoftext|> a", "many words of a long text " * 4000]


def wanted(texts, path=PATH):
    tok = Tokenizer.from_file(path)
    return [np.array([*x.ids, 1], dtype="<u4") for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_equals_library(spark):
    docs = small(spark).select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    start = 0
    for doc, want in zip(docs, wanted([d.text for d in docs]), strict=True):
        row = got[doc.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


@pytest.mark.parametrize("path", [PATH, BYTES])
def test_files(spark, tmp_path, path):
    """What is in the files, read as files, by the table and by the mapped view."""
    docs = table(spark, TEXTS).repartition(5)
    folder = write_tokens(docs, str(tmp_path / "out"), path)
    want = wanted(TEXTS, path)
    whole, index = np.concatenate(want), read_index(folder)
    assert index["width"] == 2
    files = {k: [np.fromfile(f"{folder}/{s['name']}.{k}", dtype=t) for s in index["shards"]] for k, t in (("ids", "<u2"), ("offsets", "<i8"), ("docs", "<i8"))}
    assert np.concatenate(files["ids"]).tolist() == whole.tolist()
    assert np.concatenate(files["docs"]).tolist() == list(range(len(TEXTS)))
    places = np.concatenate([o[:-1] + s["ids_before"] for o, s in zip(files["offsets"], index["shards"], strict=True)])
    assert places.tolist() == [0, *np.cumsum([len(w) for w in want])[:-1].tolist()]
    mapped = TokenFiles(folder)
    assert len(mapped) == len(TEXTS) and mapped.n_ids == len(whole)
    assert all(mapped[k].tolist() == w.tolist() for k, w in enumerate(want))
    for a, b in ((0, len(whole)), (3, 5000), (len(whole) - 7, len(whole) + 9), (4, 4)):
        assert mapped.ids(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(IndexError):
        mapped[len(TEXTS)]
    rows = read_tokens(spark, folder).orderBy("doc_id").collect()
    assert [bytes(r.ids) for r in rows] == [w.tobytes() for w in want]


def test_null_and_shared_ids(spark, tmp_path):
    rows = [(None, "b"), (5, "x"), (None, None), (5, "y"), (5, "x"), (-3, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit(1) for c in ("ids", "part", "start", "name")})
    got = read_tokens(spark, write_tokens(docs.repartition(4), f"file://{tmp_path}/t", PATH)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, None, -3, 5, 5, 5]
    ids = {t: bytes(w.tobytes()) for t, w in zip(("b", "x", None, "y", "a"), wanted(["b", "x", None, "y", "a"]), strict=True)}
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, ids[t]) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    # The order of the rows does not matter.
    again = read_tokens(spark, write_tokens(docs.orderBy(F.desc("text")), f"file://{tmp_path}/u", PATH)).orderBy("start").collect()
    assert got == again


def test_one_id_for_a_third_is_split(spark, tmp_path):
    docs = spark.range(9000).select(F.expr("case when id % 3 = 0 then 7 else id end").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    folder = write_tokens(docs, str(tmp_path / "hot"), PATH)
    assert read_tokens(spark, folder).agg(F.sum("n_tokens")).head()[0] == TokenFiles(folder).n_ids
    assert read_tokens(spark, folder).count() == 9000


def test_empty_and_again(spark, tmp_path):
    folder = str(tmp_path / "again")
    docs = table(spark, TEXTS)
    write_tokens(docs.limit(0), folder, PATH)
    assert read_tokens(spark, folder).count() == 0 and len(TokenFiles(folder)) == 0 and TokenFiles(folder).ids(0, 5).tolist() == []
    # Files of an attempt that was lost are not named, and go with the next index.
    (tmp_path / "again" / "0000000-lost.ids").write_bytes(b"half")
    write_tokens(docs, folder, PATH)
    first = {p.name for p in (tmp_path / "again").iterdir()}
    assert "0000000-lost.ids" not in first
    write_tokens(docs.where("doc_id < 3"), folder, PATH)
    assert read_tokens(spark, folder).count() == 3
    assert not first & {p.name for p in (tmp_path / "again").iterdir()} - {"index.json"}
    # A shard that is not as long as the index says is an error.
    name = read_index(folder)["shards"][0]["name"]
    (tmp_path / "again" / f"{name}.ids").write_bytes(b"\0\0")
    with pytest.raises(Exception, match="not as long"):
        read_tokens(spark, folder).collect()
