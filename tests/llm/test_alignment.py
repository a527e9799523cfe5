"""Cross-tokenizer alignment against the two libraries and byte offsets, without a transducer."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barlight.llm import alignment as A
from barlight.llm import pieces
from barlight.llm.tables import read

TEXTS = ["", None, " ", "  two  spaces", "tab\there\n  and\r\n there ", "naïve 数据 \U0001f600\U0001f600 x", "▁ mark", "a▁b", "<s> <|endoftext|> </s> <unk>", "don't won't I'll", "x" * 500, "1234567 89", "é combining  wide　x", "\x00\x07 \x1c \x85 . ", "word " * 3000, "end. ", "...  !!!   ???", "no break × y", "﻿bom"]


def ends(tokens):
    return np.cumsum([len(t) for t in tokens]).tolist()


def brute(docs):
    """The contract's columns of each (doc_id, text), from byte offsets."""
    one = Tokenizer.from_file(A.BYTE_MODEL)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    letters = A.byte_letters()
    found, count = [], Counter()
    for i, text in docs:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        of_a = [bytes(letters[c] for c in one.id_to_token(x)) for x in a]
        of_b = [bytes([int(p[3:5], 16)]) if two.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [two.id_to_piece(x)]]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        end_a, end_b = ends(of_a), ends(of_b)
        links, k = [], 0
        for j, (start, end) in enumerate(zip([0, *end_a], end_a)):
            while end_b[k] <= start:
                k += 1
            m = k
            while m < len(b) and (end_b[m - 1] if m else 0) < end:
                links.append((a[j], b[m]))
                m += 1
        both = sorted(set(end_a) & set(end_b))
        groups, x, y = [], 0, 0
        for e in both:
            to_x, to_y = end_a.index(e, x) + 1, end_b.index(e, y) + 1
            groups.append(",".join(map(str, a[x:to_x])) + "|" + ",".join(map(str, b[y:to_y])))
            x, y = to_x, to_y
        count.update(links)
        found.append((i, a, b, groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in found]


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = A.op11_cross_alignment(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs))


@pytest.mark.parametrize("most", [0, 50, A.USUAL])
def test_odd_rows_and_rare_pairs(spark, most):
    rows = [(i, t, "r", 1, "p") for i, t in enumerate(TEXTS)] + [(None, "word again", None, None, None)] * 2 + [(3, "word again", None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, pair int, n string").repartition(3)
    a, b = A.file_bytes(A.BYTE_MODEL), A.file_bytes(pieces.MODEL)
    got = A.cross_aligned(df, a, b, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert A.cross_aligned(df.where("false"), a, b).count() == 0


def test_tasks_forget_and_small_chunks(spark, monkeypatch):
    for name, value in (("KEPT", 5), ("KEPT_CHARS", 4), ("STEPS", 10), ("CHUNK", 30)):
        monkeypatch.setattr(A, name, value)
    aligner, docs = A.Aligner(A.file_bytes(A.BYTE_MODEL), A.file_bytes(pieces.MODEL)), [(i, t) for i, t in enumerate(TEXTS)]
    got = [x for part in A.batches_of(A.pa.array(TEXTS)) for x in aligner.align(part)]
    want = brute(docs)
    assert [x[:5] for x in got] == [(*w[1:5], w[7]) for w in want]


def test_transducer_steps():
    t = A.Transducer(([b"ab", b"c", b"abcd"], [b"a", b"bc", b"abc", b"d"]))
    assert t.run([0, 1], [0, 1]) == ([(0, 0), (0, 1), (1, 1)], "0,1|0,1", 1)
    assert t.run([0, 1, 0, 1], [2, 0, 1]) == ([(0, 2), (1, 2), (0, 0), (0, 1), (1, 1)], "0,1|2;0,1|0,1", 2)
    assert len(t.steps) <= 6 and t.states[0] == (0, b"")
    with pytest.raises(ValueError, match="differ"):
        t.run([1], [0])


def test_cuts():
    """Against the same rule as a pattern."""
    rule = A.re.compile(f"(?<={A.GRAPHIC})(?= )|(?<={A.LETTER})(?={A.STOP})")
    for text in [x for x in TEXTS if x] + ["a", "  a. b,c;d: e!f? (g.) 1.2, é.ß! \u0250. \u1680 x \U0001f600. y", "a.b " * 50]:
        assert A.stretches_of(text, A.kinds_of_signs(True)) == rule.split(text)
        assert A.stretches_of(text, A.kinds_of_signs(False)) == A.re.split(f"(?<={A.GRAPHIC})(?= )", text)


def test_missing_files():
    with pytest.raises(FileNotFoundError, match="no tokenizer"):
        A.file_bytes("/nowhere/a.json")
