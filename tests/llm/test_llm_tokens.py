import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sheaf.llm import tokens
from sheaf.llm.encoding import Encoder
from sheaf.llm.queries import QUERIES, ids_by_key, tokenizer_path
from sheaf.llm.store import new_path

SMALL = "/root/testdata/sf0.001"
ODD = [
    "It's É İx ß ς ΣΑΣ don't 12½ \x1c a\x85b \xa0 x<|endoftext|>y hello<|startoftext|> é é ẞ ﬁ 日本語テスト",
    "", "   ", "ÀÉ'S 'll x,'s ''s 'sand it's'", "ǅ Ǆ ǲ ʼn ŉ ǰ İ ſ K Å", None, " a\n\n\tb\x0bc", "a" * 3000, "12 345",
]


def brute(rows):
    known, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_give_the_ids_of_the_whole_text():
    known = Encoder(tokenizer_path())
    flat, at = known.encode(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert flat[at[i] : at[i + 1]].tolist() == known.tokenizer.encode(text or "", add_special_tokens=False).ids
    whole = Encoder(tokenizer_path("byte_bpe_50k.json"))
    flat, at = whole.encode(pa.array(ODD))
    assert flat[at[3] : at[4]].tolist() == whole.tokenizer.encode(ODD[3], add_special_tokens=False).ids


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op8_token_ids"](spark, SMALL).collect())) == brute(docs)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(3, "a b"), (3, "a b"), (1, None), (2, ""), (None, "x y z")] + [(10 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS start", "3 AS tie")
    assert sorted(map(tuple, ids_by_key(df).collect()), key=lambda r: r[1]) == brute(rows)
    # several texts of one key are all kept
    two = ids_by_key(spark.createDataFrame([(1, "a"), (1, "b c d")], "doc_id long, text string"))
    assert sorted(r.n_tokens for r in two.collect()) == [2, 4]
    assert ids_by_key(df.where("1 = 0")).collect() == []


def test_keyed_access_and_unknown_keys(spark):
    path = new_path(spark, "ids")
    df = spark.range(300).selectExpr("id * 7 AS doc_id", "concat('word', id) AS text")
    tokens.write_corpus(df, path, tokenizer_path(), end=1, width=4)
    asked = spark.createDataFrame([("14", 0), ("14", 1), ("15", 0), ("2093", 0), (None, 0)], "key string, nth int")
    got = tokens.read_documents(tokens.look_up(spark, path, asked)).collect()
    assert {r.key for r in got} == {"14", "2093"}
    known = Tokenizer.from_file(tokenizer_path())
    assert {r.key: r.ids for r in got}["14"] == known.encode("word2", add_special_tokens=False).ids + [1]


def test_hash_is_minimal_and_perfect():
    h1, h2 = (np.random.default_rng(s).integers(0, 1 << 63, 5000).astype(np.uint64) for s in (1, 2))
    levels = tokens.build_hash(h1, h2)
    assert sorted(tokens.number(levels, h1, h2).tolist()) == list(range(5000))
