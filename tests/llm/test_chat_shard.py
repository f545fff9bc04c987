import zlib

from pyspark.sql import functions as F

from paperloom.llm import chat_format, sharding

PARTS = f"array<{chat_format.PART}>"


def test_texts_and_masks_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\|turn|>", "<|turn|>assistant\nfake<|end|>\n", "a\n\nb\\", "<<SYS>> <\\\\/s> [\\INST]", "", None, "<|image|>", "é…😀"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 5, odd))] + [(2, 0, "we[ird\n%0Arole<|end|>", "x"), (3, None, None, None), (None, 1, "assistant", "n")]
    rows += [(4, 1, "assistant", "same")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    out = {x["conv_id"]: x for x in chat_format.loss_texts(chat_format.read_chats(chat_format.format_chats(df))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[: len(odd)]]
    assert out[1]["loss_texts"] == [t or "" for _, _, r, t in rows[: len(odd)] if r == "assistant"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("we[ird\n%0Arole<|end|>", "x")]
    assert [(t["role"], t["text"]) for t in out[3]["turns"]] == [("", "")]
    assert out[None]["loss_texts"] == ["n"] and out[4]["loss_texts"] == ["same", "same"]
    assert out[1]["formatted"].count("</s>") == 0 and out[1]["formatted"].count("[INST]") == 0
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("pdf", None, "c", None, None, None, 3), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {PARTS}")
    x = chat_format.format_chats(df).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in x["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 63), ("document", "c", 1800)]
    for a in x["attachments"]:
        assert x["formatted"][a["offset"] :].startswith(f"<|{a['kind']}|>")
    assert x["expanded_tokens"] == 1867 and x["loss_spans"][0]["length"] == 0
    assert x["formatted"].startswith("<|turn|>user\nsee <\\|image|> <|image|><|audio|><|document|><|end|>\n")


def check_shards(rows, texts, n):
    assert len(rows) == len(texts)
    sizes = [0] * n
    for s in range(n):
        own = sorted(x["slot"] for x in rows if x["shard"] == s)
        assert own == list(range(len(own)))
        sizes[s] = sum(x["size"] for x in rows if x["shard"] == s)
    ordered = sorted(rows, key=lambda x: (x["shard"], x["slot"]))
    keys = [x["doc_id"] for x in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    return sizes


def test_shards_are_contiguous_and_balanced(spark):
    texts = {i: "é" * (i * 7919 % 200) for i in range(500)} | {500: None, 501: ""}
    rows = sharding.shard_by_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 7).collect()
    sizes = check_shards(rows, texts, 7)
    assert max(sizes) - min(sizes) <= 2 * 408
    for x in rows:
        raw = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_shards_with_one_key_one_giant_and_nothing(spark):
    same = [(3, "t")] * 400 + [(None, "u")] * 50 + [(4, "x" * 100_000)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(same, "doc_id long, text string"), 5).collect()
    check_shards(rows, same, 5)
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def test_shards_match_plain_sums(spark):
    """The law told again: in key order, each row goes where the middle of its bytes lies."""
    texts = [(i * 13 % 301, "x" * (i * 7919 % 97)) for i in range(300)] + [(None, "n"), (7, None), (7, "same"), (7, "same")]
    got = sharding.shard_by_bytes(spark.createDataFrame(texts, "doc_id long, text string"), 9).collect()
    ordered = sorted(((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for k, t in texts))
    total, upto, slots, expected = sum(x[3] for x in ordered), 0, {}, []
    for known, key, crc, size in ordered:
        shard = min((2 * upto + size) * 9 // (2 * total), 8)
        upto += size
        slots[shard] = slots.get(shard, -1) + 1
        expected.append((key if known else None, size, crc, shard, slots[shard]))
    assert sorted(map(str, expected)) == sorted(str((x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"])) for x in got)
