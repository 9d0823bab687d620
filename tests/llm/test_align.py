"""Alignment of two tokenizers against a brute force over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers

from weft.llm import align

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "a", "a ", " a", "  a  b ", "a\n b", "a \nb\t", "don't stop <|endoftext|> </s> <0x41> <unk>", "▁ x", "ﬁ ① é é   x  y　 z", "日本語 テスト 🙂🙂 ok", "x" * 300 + " " + "y " * 300,
    "\x1c a\x1c b", "\r\n \r\n", "a  b", "word " * 20_000, "\x00 nul", "same words here", "same words here", " .,;!? 12 345 6789", "A" * 30_000,
]


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    t.encode_special_tokens = True
    to = align.byte_level()
    names = {i: x for x, i in t.get_vocab().items()}
    a_bytes = lambda i: bytes([to[c] for c in names[i]])
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, links = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if not text or any(b"".join(map(f, x)) != (" " + text).encode() for f, x in ((a_bytes, a), (b_bytes, b))):
            docs.append(None)
            continue
        spans = []
        for f, x in ((a_bytes, a), (b_bytes, b)):
            at, own = 0, []
            for i in x:
                own.append((at, at := at + len(f(i)), i))
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = [], []
            while i < len(a) and spans[0][i][1] <= c:
                x.append(spans[0][i])
                i += 1
            while j < len(b) and spans[1][j][1] <= c:
                y.append(spans[1][j])
                j += 1
            groups.append((x, y))
        mine = [(p[2], q[2]) for x, y in groups for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
        links.update(mine)
        said = ";".join(",".join(str(p[2]) for p in x) + "|" + ",".join(str(q[2]) for q in y) for x, y in groups)
        docs.append((len(a), len(b), len(groups), mine, hashlib.sha256(said.encode()).hexdigest()))
    top = Counter()
    for (_, q), n in links.items():
        top[q] = max(top[q], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(links[x] == top[x[1]] for x in d[3]), sum(links[x] for x in d[3]), d[4]) for d in docs]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7 if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string").repartition(3)
    want = sorted(brute(TEXTS))
    assert sum(x[0] > 0 for x in want) >= 15
    assert rows_of(align.align(spark, docs, PATHS)) == want
    assert rows_of(align.align(spark, docs, PATHS, frequent=50)) == want  # nearly all pairs by the join
    assert align.align(spark, docs.limit(0), PATHS).count() == 0


def test_blocks_of_any_size():
    import numpy as np

    r = np.random.default_rng(5)
    for size in (1, 2, 7, 5000):
        total = 600
        ends = [np.append(np.sort(r.choice(np.arange(1, total), 200, replace=False)), total) for _ in range(2)]
        ids = [r.integers(0, 50, 201) for _ in range(2)]
        lengths = [np.diff(e, prepend=0) for e in ends]
        blocks = sorted((int(ends[s][i] - lengths[s][i]), s, i) for s in (0, 1) for i in range(0, 201, size))
        one, cut = align.Sweep(), align.Sweep()
        for s in (0, 1):
            one.add(s, 0, ids[s], lengths[s])
        for at, s, i in blocks:
            cut.add(s, at, ids[s][i : i + size], lengths[s][i : i + size])
        assert one.result() == cut.result()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(align.align(spark, docs, PATHS)) == sorted(brute([r.text for r in docs.select("text").collect()]))
