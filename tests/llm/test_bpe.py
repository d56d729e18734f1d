import hashlib
import random

from fixtures import EDGE, docs, prose
from tokenizers import Tokenizer

from tomewright.llm import bpe
from tomewright.llm.common import word_vocabulary

ALPHABET = "abcdefghijklmnopqrstuvwxyzÀÉñ日本語éİﬁΣς'’.,!<|>endoftextstartoftext 0123​\x00\x1c\x85́̇ 🙂힣가"


def expected(texts):
    t = Tokenizer.from_file(word_vocabulary())
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield ids, t.decode(ids, skip_special_tokens=False)


def test_encoder_equals_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>ΣΑΣ b<|startoftext|><|endoftext|>", "<|endoftext", "\0\0<|endoftext|>", "a" * 5000, "it's I'LL we'Ve ''s", prose(1, 3000)]
    enc = bpe.WordBpe(word_vocabulary(), keep=500)  # emptied often
    for text, (ids, back), (want, want_back) in zip(texts, enc.encode(texts), expected(texts)):
        assert list(memoryview(ids).cast("I")) == want, text
        assert back == want_back and enc.decode(want) == want_back


def test_query_rows(spark):
    for extra in (False, True):
        got = bpe.encode_documents(docs(spark, EDGE, extra), word_vocabulary(), with_ids=True).collect()
        texts = [t for _, t in EDGE]
        assert len(got) == len(EDGE)
        want = sorted((str(i), len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids)
                      for (i, _), (ids, back) in zip(EDGE, expected(texts)))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got) == want
    assert bpe.encode_documents(docs(spark, []), word_vocabulary()).count() == 0


def test_documents(spark, data):
    from tomewright.llm.catalog import queries

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids_sha256 for r in queries()["op4_bpe_encode"](spark, data).collect()}
    for r, (ids, _) in zip(rows, expected([r.text for r in rows])):
        assert got[r.doc_id] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
