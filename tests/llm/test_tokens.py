import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import packing as P
from plumbline.llm.tokens import encode

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(P.VOCABULARY)
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_encode_as_whole_texts(tokenizer):
    r = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", " ", " ", "　", "\u0085", " ", "​", "\x1c", "a", "é", "B1", "'s", "don't", "###", "漢字", "😀", "<|endoftext|>", "ß", " x", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(5000)] + [None, "", "word " * 3000]
    flat, offsets = encode(pa.array(texts), PATH)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert flat[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def check(rows, tokenizer, texts, capacity, max_docs=None):
    fill, whole = Counter(), {}
    places = {}
    for x in rows:
        fill[x.sequence_id] += x.length
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
        whole.setdefault(x.doc_id, []).append(x)
    assert max(fill.values()) <= capacity
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and len(own) <= (max_docs or capacity)
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(whole[i], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(-(-len(ids) // capacity))) and all(x.length == capacity for x in own[1:])
        for x in own:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
        assert sum(x.length for x in own) == len(ids)
    return fill


def test_pack_round_trip(spark, tokenizer):
    r = random.Random(5)
    texts = [(0, None), (1, ""), (2, "word " * 9000), (3, "x")] + [(i, " ".join(r.choice(["alpha", "be", "gam ma", "\n"]) for _ in range(r.randint(1, 300)))) for i in range(4, 160)]
    df = spark.createDataFrame(texts, SCHEMA).selectExpr("*", "'x' AS piece", "1 AS length", "2 AS bucket", "3 AS place")
    rows = P.pack(df, tokenizer_path=PATH, capacity=256).collect()
    fill = check(rows, tokenizer, texts, 256)
    assert len(fill) <= 1.02 * -(-sum(fill.values()) // 256) + 1
    rows = P.pack(df, tokenizer_path=PATH, capacity=256, max_docs=2, score="dot").collect()
    check(rows, tokenizer, texts, 256, 2)


def test_pack_repeated_rows_ids_and_nothing(spark):
    same = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    rows = P.pack(spark.createDataFrame(same, SCHEMA), tokenizer_path=PATH, with_ids=True).collect()
    assert len(rows) == 4 and len({x.sequence_id for x in rows}) == 1 and sum(x.length for x in rows) == max(x.offset + x.length for x in rows)
    assert sorted(x.ids[-1] for x in rows) == [2] * 4
    assert P.pack(spark.createDataFrame([], SCHEMA), tokenizer_path=PATH).count() == 0


@pytest.mark.parametrize("score", ["residual", "dot"])
def test_vector_best_fit_holds_every_constraint(score):
    r = random.Random(9)
    counts = {r.randint(1, 77): r.randint(1, 400) for _ in range(60)}
    runs = P.vector_best_fit(counts, 100, 5, 6000, score)
    tokens, docs, cost, placed = Counter(), Counter(), Counter(), Counter()
    for size, _, n, first, offset in runs.tolist():
        for b in range(first, first + n):
            assert tokens[b] == offset
            tokens[b] += size
            docs[b] += 1
            cost[b] += size * size
        placed[size] += n
    assert placed == Counter(counts) and max(tokens.values()) <= 100 and max(docs.values()) <= 5 and (max(cost.values()) <= 6000 or max(counts) ** 2 > 6000)


def test_vector_best_fit_refuses_what_never_fits():
    with pytest.raises(ValueError):
        P.vector_best_fit({90: 1}, 100, 5, 6000)


@pytest.mark.parametrize("score", ["residual", "dot"])
def test_bins_are_few_under_every_constraint(score):
    """Bins against what the sums of needs and the pieces that share with none demand, constraints binding in turn."""
    import math
    import random

    from plumbline.llm.packing import vector_best_fit

    used = lambda runs: int((runs[:, 2] + runs[:, 3]).max())
    assert used(vector_best_fit({10: 1000}, 1024, 1024, 1024**2, score)) == 10
    r = random.Random(3)
    every: dict[int, int] = {}
    for _ in range(8000):
        n = min(1024, int(r.expovariate(1 / 300)) + 1)
        every[n] = every.get(n, 0) + 1
    for docs, attention, slack in ((1024, 1024**2, 1.01), (4, 1024**2, 1.3), (1024, 300_000, 1.2), (3, 400_000, 1.05)):
        counts = {n: c for n, c in every.items() if n * n <= attention}
        sums = [sum(n * c for n, c in counts.items()) / 1024, sum(counts.values()) / docs, sum(n * n * c for n, c in counts.items()) / attention, sum(c for n, c in counts.items() if 2 * n > 1024 or 2 * n * n > attention)]
        assert used(vector_best_fit(counts, 1024, docs, attention, score)) <= slack * math.ceil(max(sums)), (docs, attention)
