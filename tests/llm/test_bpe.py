import base64
import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from matgraph.llm import bpe

FILE = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})


def ids_of(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def samples():
    rng = random.Random(5)
    out = ["", " ", "   a", "it's we'll I'D", "<|endoftext|>", "a\r\n\r\n b \t\t", "1234567 ½ ²", "naïve Übergröße", "日本語のテキスト", "🙂🙂👩‍👩‍👧", " x y\x85z", "é́", "aaaa" * 50]
    for _ in range(200):
        out.append("".join(rng.choice("abcdeéß  \n\t.,!?'0123AZ日🙂-_") for _ in range(rng.randrange(120))))
    return out


def test_equals_the_library(own, reference):
    for t in samples():
        (got,) = own.encode([t])
        assert ids_of(got) == reference.encode_ordinary(t), repr(t)
        assert own.decode([got]) == [t.encode()]


def test_long_pieces_and_texts(own, reference, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    assert ids_of(own.encode([long])[0]) == reference.encode_ordinary(long)
    with_recursion = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, bpe.LONG))) for _ in range(200)]
    together = own._contract_together([t.encode() for t in with_recursion])
    assert [ids.tolist() for ids in together] == [ids_of(own.encode([t])[0]) for t in with_recursion]
    assert not own.long and long not in own.young
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    text = "Some words, and 12 numbers.\n\n  " * 300
    assert ids_of(own.encode([text])[0]) == reference.encode_ordinary(text)


def unbroken(rng, n):
    """A long piece: letters, pieces of words, one sign, or characters of several bytes."""
    parts = rng.choice(["abcdefghijklmnopqrstuvwxyz", ["the", "and", "ing", "tion", "er", "on", "st"], "a", "=", "─", "éèàüßÃÂ漢字─", ["abc"], ["─═", "xyzzy"]])
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("window", [200, 333, 1000])
def test_windows_of_long_pieces(own, reference, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(60):
        texts = [unbroken(rng, rng.randrange(50, 1500)) for _ in range(3)]
        assert [ids_of(x) for x in own.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_ranks_in_any_order():
    """Vocabularies whose tokens other merges make, or none: rank by rank equals pair by pair."""
    rng = random.Random(8)
    for _ in range(60):
        long = sorted({bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(rng.randrange(40))})
        rng.shuffle(long)
        ranks = {t: k for k, t in enumerate([*(bytes([b]) for b in range(256)), *long])}
        file = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
        codec = bpe.Codec(file, ".+")
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 60))) for _ in range(20)]
        for piece, got in zip(pieces, codec._contract_together(pieces)):
            parts = [bytes([b]) for b in piece]
            while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got.tolist() == [ranks[p] for p in parts]


LONG_TEXTS = {
    "rules": lambda n: (" " + "-" * 64 + "\n") * (n // 66),
    "mojibake": lambda n: "ÃÂ" * (n // 4),
    "letters": lambda n: "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=n)),
    "sign": lambda n: "=" * n,
}


def test_long_texts_through_spark(spark, reference):
    """Texts of 16 MB of long tokens, and of 4 MB in one piece."""
    texts = {k: make(16 << 20 if k in ("rules", "mojibake") else 4 << 20) for k, make in LONG_TEXTS.items()}
    rows = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    found = bpe.encode(rows, FILE, public_tokenizers.PATTERN).selectExpr("doc_id", "sha2(ids, 256) AS ids", "sha2(decoded, 256) AS decoded").collect()
    for i, text in enumerate(texts.values()):
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert tuple(next(r for r in found if r["doc_id"] == i)) == (i, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("kind", sorted(LONG_TEXTS))
def test_memory_of_long_texts(kind):
    """A worker's memory for 16 MB: at most 600 MB, of which 200 are the codec."""
    code = f"""
import sys
sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(bpe.__file__)))), os.path.dirname(__file__)]}
import test_bpe as t
text = t.LONG_TEXTS[{kind!r}](16 << 20)
codec = t.bpe.Codec(t.FILE, t.public_tokenizers.PATTERN)
assert codec.decode(codec.encode([text])) == [text.encode()]
print(next(int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 600, out.stderr


def test_small_cache_changes_nothing(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    for t in samples()[-30:]:
        assert ids_of(own.encode([t])[0]) == reference.encode_ordinary(t)


def test_encode_and_decode_tables(spark, reference):
    texts = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (3, ""), (None, "x y"), (4, "long text " * 400_000)]
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], "doc_id long, text string, ids string, decoded string")
    got = bpe.encode(rows, FILE, public_tokenizers.PATTERN)
    want = sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)
    assert sorted((str(r["doc_id"]), ids_of(bytes(r["ids"])), bytes(r["decoded"])) for r in got.collect()) == want
    back = bpe.decode(got, FILE, public_tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back.collect()) == sorted((a, c) for a, _, c in want)
    assert bpe.encode(rows.limit(0), FILE, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("length", [60, bpe.LONG, 200, 900])
def test_many_long_pieces_stay_within_memory(own, reference, length):
    rng = random.Random(length)
    text = " ".join("".join(rng.choice("acgt") for _ in range(length)) for _ in range(20_000 if length == 60 else 2000))
    (got,) = own.encode([text])
    assert ids_of(got) == reference.encode_ordinary(text) and own.decode([got]) == [text.encode()]


def test_decoding_reads_the_ids_and_nothing_else(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "TOKENS", 7)
    texts = samples()[:40]
    packed = [np.array(reference.encode_ordinary(t)[::-1], "<u4").tobytes() for t in texts]
    assert own.decode(packed) == [b"".join(reference.decode_single_token_bytes(i) for i in reference.encode_ordinary(t)[::-1]) for t in texts]
    assert own.decode([]) == [] and own.decode([b""]) == [b""]
