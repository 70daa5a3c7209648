import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rxlake.llm import packing as P, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "a", "  two  spaces ", "don't 's 'll I'VE", "Line.\n\nNext  \t line \n", "é é ñ", "中文 字 🙂 ok",
       "x   y z", "́ start", "a ́b", "tab\tand \r\n end ", "<|endoftext|> <|startoftext|>", "12 3456 7,8.9 !!! ?!",
       "İstanbul ΑΣ ΟΔΟΣ straße", "a\x85b \x1c c", " lead", "trail ", "word​join ﻿ bom", "A" * 300 + " " + "z9" * 400]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    rnd = random.Random(2)
    texts = ODD + ["".join(map(chr, range(0xC0, 0x100))), " ".join(f"x{chr(c)}y. {chr(c)}, {chr(c)}" for c in range(0xA1, 0x250))] + ["".join(rnd.choice("ab é.,'\n\t 0中́!sS") for _ in range(60)) for _ in range(300)]
    texts += ["".join(rnd.choice(["ab", "Él", ".", "***", "\n", "'s", "-", "7", "×", "ÿ", " ", "`{", "_"]) for _ in range(40)) for _ in range(400)]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    enc = tokens.Encoder(path)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts + [None])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts] + [[]]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_remembered_pieces_are_bounded_in_bytes(path, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000, raising=False)
    monkeypatch.setattr(tokens, "RECENT", 50, raising=False)
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdeéK.\n-") for _ in range(n))
    texts = [" ".join("x" + word(rnd.choice([2, 6, 12])) + "y" for _ in range(40)) for _ in range(60)]
    texts += [f"a {'中文' * 500}{i} b {'z' * (900 + i)} c" for i in range(60)] + ["a \u212a \u212aa \u212b. İ b"]
    t = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    for _ in range(2):
        for i in range(0, len(texts), 7):
            got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts[i:i + 7])]
            assert got == [t.encode(x, add_special_tokens=False).ids for x in texts[i:i + 7]]
    held = [sum(len(k.encode()) + len(v) for k, v in held.items()) for held in (enc.known, enc.parts)]
    assert 1_000 < min(held) and max(held) < 40_000


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_words_that_end_in_a_digit(path):
    """They once took time exponential in their length."""
    text = f"a {'z' * 60}7 b {'é' * 60}.\n{'y' * 60}8, c"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.Encoder(path).encode([text])[0], "<u4").tolist() == want


def test_least_cost_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randrange(2, 40)
        at = np.array([0, *np.cumsum([rnd.randrange(1, 9) for _ in range(n)])])
        pen = np.array([0.0, *[rnd.choice([0, 2, 24]) for _ in range(n)]])
        window = rnd.randrange(9, 30)
        best = [0.0] + [None] * n
        for i in range(1, n + 1):
            best[i] = min(best[j] + window - (at[i] - at[j]) for j in range(i) if at[i] - at[j] <= window) + pen[i]
        w = P.choose_windows(at, pen, window, True)
        cost = sum(window - (b - a) for a, b in zip([0, *w], w)) + sum(pen[np.searchsorted(at, x)] for x in w)
        assert w[-1] == at[-1] and all(b - a <= window for a, b in zip([0, *w], w)) and cost == best[n]


def check(rows, docs, window):
    """Every id once, sequences gapless; returns padded share."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    enc = tokens.encoder(WORD)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(enc.encode([t])[0] + b"\1\0\0\0")
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) > 1:
            continue
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == want[i][0]
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        assert {p["doc_tokens"] for p in pieces} == {len(want[i][0]) // 4}
    padding = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        n = sum(p["length"] for p in pieces)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
        total += n
    return padding / total


def test_pack(spark, monkeypatch):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["Alpha", "beta.", "gamma", "ünd", "x!"]) for _ in range(rnd.choice([0, 1, 30, 200, 5000]))))
            for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, None), (201, ""), (7, "again"), (300, "nostop " * 4000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, start string").repartition(3)
    rows = [r.asDict() for r in P.pack(df, WORD, window=256).collect()]
    assert check(rows, docs, 256) < 0.02
    assert sum(r["doc_tokens"] for r in rows if r["doc_id"] in (200, 201)) == 2
    assert P.pack(df.limit(0), WORD).count() == 0


def test_report(spark):
    df = spark.createDataFrame([(1, "one two. three"), (2, None)], "doc_id long, text string").coalesce(1)
    ids = tokens.encoder(WORD).encode(["one two. three"])[0] + b"\1\0\0\0"
    got = P.report(df, WORD).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(ids) // 4
    assert got[-1].ids_crc32 == zlib.crc32(b"\1\0\0\0")
