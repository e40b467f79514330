"""Token alignment against a plain version that encodes whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import alignment

PATHS = [public_tokenizers.path(x) for x in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
ODD = ["", " ", "  two  spaces ", "\ttab\nline  \n", "a", "don't stop_me now!", "<|endoftext|> <s> </s> <unk>", "naïve café — “quoted” 日本語のテキスト ▁mark a ▁b", "x" * 5000, "nb sp a  b  c d  e 　f", "emoji 👩‍👩‍👧 ok", "é \x00 \x1c y", "١٢٣ 4,567.89 http://a.b/c?d=e#f", "word " * 40]


def plain_version(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    ta.encode_special_tokens = True
    byte = alignment.alphabet()
    done = []
    for text in texts:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        ra = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a]
        rb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]
        if not text or b"".join(ra) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
            done.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ra]).tolist(), np.cumsum([len(x) for x in rb]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(p, q) for p, (s, e) in zip(a, zip([0, *ea], ea)) for q, (t, f) in zip(b, zip([0, *eb], eb)) if s < f and t < e]
        done.append((len(a), len(b), groups, links))
    count = Counter(x for d in done if d for x in d[3])
    best = Counter()
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in d[2])
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_cuts():
    for seed in range(200):
        draw = np.random.default_rng(seed)
        size = int(draw.integers(1, 60))
        a, b = (np.unique(np.append(draw.integers(1, size + 1, draw.integers(1, 30)), size)) for _ in range(2))
        x, y = alignment.shared_cuts(a, b)
        assert a[x - 1].tolist() == b[y - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]]
        assert list(zip(*(z.tolist() for z in alignment.overlaps(a, b)))) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n\t'1é日 ▁ 　\x1f-S")), max_size=40))
def test_units_are_the_whole(text):
    """Units encoded by themselves join to the text encoded whole."""
    import pyarrow as pa

    pair = alignment.tokenizers(*PATHS)
    memo = alignment.Memo(pair)
    block = alignment.Block(memo)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    block.add(pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"]), raw, np.array([0, len(raw)]))
    (want,) = plain_version([text])
    assert (*block.rows[0][0].tolist(), block.digests[0]) == (*want[:4], want[6])


@pytest.mark.parametrize("limit", [alignment.BLOCK_BYTES, 300])
def test_documents(spark, limit):
    draw = np.random.default_rng(5)
    words = [w for x in ODD for w in x.split(" ") if w] + ["the", "unbelievable", "Straße", "tokenization", "Überraschung", "12345"]
    texts = [*ODD, *(" ".join(words[i] for i in draw.integers(0, len(words), 60)) for _ in range(12)), ODD[5], None]
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pairs int").repartition(3)
    got = Counter(map(tuple, alignment.align_documents(docs, limit=limit).collect()))
    want = plain_version([t or "" for t in texts])
    assert got == Counter((r[0], *w) for r, w in zip(rows, want))
    assert alignment.align_documents(docs.limit(0)).count() == 0
    linked = alignment.token_links(docs).collect()
    assert sum(r.n for r in linked) == sum(w[3] for w in want) and all(0 <= r.b < 32_000 for r in linked)
