import base64
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import bpe, decontaminate, token_files
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "Hello world, it's fine.", "a" * 900, "x y " * 300, "\n \n" * 200 + "end", "we'll've " * 120, "naïve çé 漢字 😀 " * 60, " " * 700, "é́H̱ İstanbul ΟΔΟΣ ", "<|endoftext|> a<|startoftext|>"]


def encoding():
    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_chunked_encoding_equals_whole_encoding(spark):
    rows = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(TEXTS)] + [(0, "", "x")], "doc_id long, text string, ids string")
    vocabulary, whole = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN), encoding()
    for params in (bpe.BpeParams(), bpe.BpeParams(200, 40), bpe.BpeParams(64, 20)):
        out = bpe.encode(rows, vocabulary, params=params, decoded="bytes").collect()
        assert len(out) == len(TEXTS) + 1
        for x in out:
            t = TEXTS[x["doc_id"]] or ""
            assert x["ids"] == whole.encode_ordinary(t)
            assert bytes(x["bytes"]) == t.encode()
    again = bpe.decode(bpe.encode(rows, vocabulary), vocabulary).collect()
    assert all(bytes(x["decoded"]) == (TEXTS[x["doc_id"]] or "").encode() for x in again)
    assert bpe.encode(rows.limit(0), vocabulary).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_come_back_and_are_addressable(ids):
    array = np.array(ids, np.uint32)
    segment = token_files.Segment(token_files.pack(array))
    assert (segment.slice(0, len(ids)) == array).all()
    assert (segment.take(np.arange(len(ids))[::-1]) == array[::-1]).all()
    for i in range(0, len(ids), 37):
        assert segment.get(i) == ids[i]
        assert (segment.slice(i, min(i + 41, len(ids))) == array[i : i + 41]).all()


def test_token_files_equal_the_library(spark, tmp_path):
    rows = [(i * 3 % 11, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, TEXTS[2]), (4, TEXTS[2])]
    vocabulary = token_files.WordVocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, path, 1)
    out = sorted(token_files.read_documents(spark, path).collect(), key=lambda x: x["start"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
    start, every = 0, []
    for x, (key, text) in zip(out, ordered, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (x["doc_id"], x["start"], x["n_tokens"]) == (key, start, len(ids))
        assert x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        every += ids
    places = [*range(start), 5, 5, start, -1, None]
    wanted = spark.createDataFrame([(p,) for p in places], "position long")
    got = token_files.read_tokens(spark, path, wanted).collect()
    assert len(got) == len(places)
    assert {x["position"]: x["token"] for x in got} == {p: every[p] if p is not None and 0 <= p < start else None for p in places}
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary, empty, 1)
    assert token_files.read_documents(spark, empty).count() == 0


def test_words_equal_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    r = random.Random(3)
    pieces = ["Tho", "é", "ÉCOLE", "ß", "'s", "don't", ".", ",,", "%%", "12", "a1", "ñ", " ", "\n", " ", "́", "漢", "...", "-", "|", "Ω", "İ", "\x1c"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(400)]
    for text, ids in zip(texts, encoder.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_in_every_case_equal_the_library():
    """What is a special string only in another case is text like any other, wherever it is glued to something."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    r = random.Random(11)
    parts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startOfText|>", "<|endoftext|", "|>", "<|", "X", "é", "Word", ".", " ", "\n", "9", "É́"]
    texts = ["<|ENDOFTEXT|>x", "a<|EndOfText|>b", "<|STARTOFTEXT|>x", "<|ENDOFTEXT|>", "<|endoftext|>A<|ENDOFTEXT|>"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tiles_match_plain_version():
    r = random.Random(3)
    for _ in range(250):
        v = r.choice([3, 8, 30])
        item, text = [r.randrange(v) for _ in range(r.randrange(3, 50))], []
        for _ in range(r.randrange(1, 5)):
            a = r.randrange(len(item))
            text += item[a : a + r.randrange(1, 30)] + [r.randrange(v) for _ in range(r.randrange(4))] + [None] * (r.random() < 0.3)
        assert sum(x[2] for x in decontaminate.tile(item, text, 5)) == brute.tiles(item, text, 5)


def test_contamination(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(30)] for i in range(6)}
    filler = lambda n: " ".join(word() for _ in range(n))
    whole = lambda i: " ".join(items[i])
    docs = {
        1: filler(50) + " " + whole(0) + " " + filler(50),
        2: filler(20) + ", ".join(items[1]).upper() + "! " + filler(5),
        3: " ".join(items[2][20:]) + " " + filler(9) + " " + " ".join(items[2][:10]) + ". " + filler(9) + " " + " ".join(items[2][10:20]),
        4: filler(60) + " " + " ".join(items[3][:12]),
        5: filler(100),
        6: None,
        7: "",
        8: whole(4) + " " + whole(5),
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "y")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(0, whole(0)), (9, "too short"), (10, None)], "item_id long, text string")
    for chars in (8_000_000, 200):
        out = decontaminate.contaminated(d, b, params=decontaminate.TilingParams(block_chars=chars)).collect()
        assert {(x["doc_id"], x["item_id"]) for x in out} == {(1, 0), (2, 1), (3, 2), (8, 4), (8, 5)}
        assert all(x["coverage"] > 0.9 for x in out)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Blue Whale Song"), (2, "鯨は海で最も大きな動物です"), (3, "ปลาวาฬเป็นสัตว์ใหญ่"), (4, "eins zwei drei vier fünf sechs"), (5, "..."), (6, None), (7, "Zebra")]
    docs = {
        1: "they heard a blue whale song at night",
        2: "blue whale, and then a song",
        3: "図鑑によると鯨は海で最も大きな動物ですと書いてある",
        4: "鯨は魚です",
        5: "เขาว่าปลาวาฬเป็นสัตว์ใหญ่มาก",
        6: "blue whale song, vorher eins zwei drei vier fünf sechs; BLUE WHALE SONG",
        7: "two zebras",
        8: "a zebra",
        9: "eins zwei drei vier",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **p: {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b, params=decontaminate.TilingParams(**p)).collect()}
    every = {(1, 1), (3, 2), (5, 3), (6, 1), (6, 4), (8, 7)}
    assert found() == every and found(block_chars=20) == every
    assert found(min_item=2) == every - {(8, 7)}


def test_repeated_tokens_are_tiled_in_time():
    import time

    began = time.time()
    assert decontaminate.tile([1] * 400, [1] * 4000, 5) == [(0, 0, 400)]
    assert time.time() - began < 2


def test_tiles_in_blocks_of_pairs_match_plain_version(monkeypatch):
    r = random.Random(40)
    for _ in range(300):
        kinds = r.choice([2, 3, 8])
        item = [r.randrange(kinds) for _ in range(r.randrange(1, 25))]
        text = [None if r.random() < 0.1 else r.randrange(kinds) for _ in range(r.randrange(1, 40))]
        least = r.choice([1, 2, 3, 5])
        found = decontaminate.tile(item, text, least)
        assert sum(n for _, _, n in found) == brute.tiles(item, text, least)
        monkeypatch.setattr(decontaminate, "PAIRS", 3)
        assert decontaminate.tile(item, text, least) == found
        monkeypatch.undo()
