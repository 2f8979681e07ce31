import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from loomframe.llm import bpe
from loomframe.llm.queries import TOKENIZER

TEXTS = ["", "a", "The tokenizer's words, I'll say.\n\n  \tdone  ", "é" * 300, "a" * 5000, "😀" * 200, "<|endoftext|> x", "ab" * 40 + "thethe" * 33, "\r\n\x0b 12345 %%%"]


def reference():
    ranks = bpe.load_merges(TOKENIZER.path).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matrix_and_heap_equal_the_library():
    rng = random.Random(3)
    texts = [*TEXTS, *("".join(chr(rng.choice([rng.randint(1, 255), rng.randint(256, 0xD7FF)])) for _ in range(500)) for _ in range(20))]
    texts += ["".join(rng.choice("thean ") for _ in range(3000)), "".join(rng.choice("entionr") for _ in range(2000))]
    merges, library = bpe.load_merges(TOKENIZER.path), reference()
    for text, ids in zip(texts, bpe.Encoder(merges, public_tokenizers.PATTERN).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode_ids(merges, ids) == text.encode()


def test_worker_table_starts_anew_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    encoder, library = bpe.Encoder(bpe.load_merges(TOKENIZER.path), public_tokenizers.PATTERN), reference()
    for text in TEXTS * 2:
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_frames(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (1, "a", "", ""), (99, "long text, " * 400_000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = TOKENIZER.decode(TOKENIZER.encode(docs)).collect()
    assert len(got) == len(rows)
    library = reference()
    for r in got:
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text)
        assert hashlib.sha256(bytes(r["decoded"])).digest() == hashlib.sha256(text.encode()).digest()
    both = TOKENIZER.encode(docs, decoded="decoded")
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and both.count() == len(rows)
    assert TOKENIZER.encode(docs.limit(0)).collect() == []
