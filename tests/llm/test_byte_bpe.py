import random

import public_tokenizers
import pytest
import tiktoken

from hostshelf.llm import byte_bpe, vocab

RANKS = vocab.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rnd = random.Random(11)
    pools = ["abc  \t\n\r\x0b\x0c'sdllm tveRE ", "0123456789²½Ⅷ٣", "éüßñÇ漢字かなй́‍😀👨‍👩‍👧", "  　\u0085᠎​ ", "#$%&|<>!?.,", "ⰀꝽ𞥀𑄀𐀀"]
    out = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(200)]
    return out + ["", " ", "\n\n\n", "<|endoftext|>", "a" * 5000, "= " * 900, "Don't we'll", "x" * 199 + "é" * 100, "ab" * 99, "-" * 250]


@pytest.mark.parametrize("native", [False, True])
def test_ids_and_bytes_equal_the_library(frame, library, native):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.ids for r in byte_bpe.encoded(frame(rows), RANKS, native=native).collect()}
    assert {i: library.encode_ordinary(t) for i, t in rows} == got


@pytest.mark.parametrize("native", [False, True])
def test_report_hashes(frame, library, native):
    import hashlib
    rows = [(1, "one two  three"), (2, None), (2, "x"), (2, "x"), (None, "née"), (3, "")]
    def want(i, t):
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())
    got = [tuple(r) for r in byte_bpe.report(frame(rows), RANKS, native=native).collect()]
    assert sorted(got, key=repr) == sorted((want(*r) for r in rows), key=repr)


def test_portions_of_few_tokens_and_a_long_document(frame, library, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(byte_bpe, "PORTION", 50)
    tokens = [[f"w{i % 7}" for i in range(n)] for n in (0, 3, 200, 0, 49, 2, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    back = {}
    for b in byte_bpe._portions(iter([batch])):
        words = [bytes.fromhex(w).decode() for w in b.column("words")[0].as_py()]
        ends, at = b.column("ends")[0].as_py(), 0
        numbers = __import__("numpy").frombuffer(b.column("numbers")[0].as_py(), "<i4")
        for i, e in zip(b.column("doc_ids")[0].as_py(), ends):
            back[i], at = [words[n] for n in numbers[at:e]], e
    assert back == dict(enumerate(tokens))


def test_long_words_follow_the_same_merges(library):
    rnd = random.Random(3)
    for _ in range(60):
        word = "".join(rnd.choices(rnd.choice(["ab", "aeiounrst", "é漢a", "="]), k=rnd.randint(1, 400)))
        assert byte_bpe.merged_long(word.encode(), RANKS) == library._encode_single_piece(word.encode())
        assert byte_bpe.merged(word.encode(), RANKS) == library._encode_single_piece(word.encode())


def test_vocabulary_files_agree():
    ranks, special = vocab.json_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ranks == vocab.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert special == {"<|endoftext|>": 50256}
    assert vocab.PATTERN == public_tokenizers.PATTERN


def test_empty_table(frame):
    assert byte_bpe.report(frame([(1, "a")]).where("false"), RANKS).collect() == []
