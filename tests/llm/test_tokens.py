import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import pretokens, tokens

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", " ", "\n\n", "it's", "'s", "''s 's\n's", "a" * 5000, "ab" * 3000, "x  \n y", "<|endoftext|> é数😀​  Ⅷ²", "they'll've'dx 'Re", "\0\0 \0", "   end   "]


@pytest.fixture(scope="module")
def reference():
    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.VOCABULARY), special_tokens={})


def test_random_texts(reference):
    r, letters = random.Random(5), "'srtevmld ab1 \n\t\r!.é 　Ωж数😀​\x1c\x00Ⅷ²"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 16))) for _ in range(4000)]
    flat, at = tokens.local_encoder().encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_every_code_point(reference):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"\n\na{chr(c)} 1{chr(c)} !{chr(c)}" for c in points[k : k + 20000]) for k in range(0, len(points), 20000)]
    for t in texts:
        assert tokens.local_encoder().encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_scan_composes_functions():
    r = np.random.default_rng(2)
    t = r.integers(0, 4, (5, 4)).astype(np.uint8)
    t[0] = 2
    for _ in range(50):
        c = np.r_[0, r.integers(0, 5, 200)]
        want, s = [], 0
        for x in c:
            s = t[x, s]
            want.append(s)
        assert pretokens.scan_states(c, t).tolist() == want


def test_frame(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(100, None, None), (101, None, "b"), (5, ODD[5], "again"), (None, "no key", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokens.encode(df, "text", ["doc_id"], offsets=True).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(k), reference.encode_ordinary(t or "")) for k, t, _ in rows)
    ranks = {i: b for b, i in tokens.load_ranks(tokens.VOCABULARY).items()}
    by = {k: t for k, t, _ in rows}
    for r in got:
        raw = (by[r.doc_id] or "").encode()
        assert all(raw[o : o + len(ranks[i])] == ranks[i] for i, o in zip(r.ids, r.offsets))
    back = tokens.decode(tokens.encode(df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()
    assert all(r.text == (by[r.doc_id] or "") for r in back)
    assert {r.doc_id: r.tokens for r in tokens.count(df, "text", ["doc_id"]).collect()} == {r.doc_id: len(r.ids) for r in got}
    assert tokens.encode(df.where("false"), "text", ["doc_id"]).count() == 0


def test_invalid_bytes(spark):
    df = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", F.expr("cast(x'61ff62' as string)").alias("text"))
    flat, _ = tokens.local_encoder().encode(["a�b"])
    assert list(tokens.encode(df, "text", ["doc_id"]).first().ids) == flat.tolist()
