import random

from paperloom.llm import line_dedup, ngram_join, span_dedup
from tests.llm import brute

WORDS = [a + b for a in "ka lo mi ne pu ra si to ve zu".split() for b in "bar dan fel gor hin jas".split()]


def text(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(r.choice(WORDS) + r.choice(WORDS) + ("." if r.random() < 0.15 else "") + ("\n" if r.random() < 0.04 else " "))
    return "".join(out).strip()


def near(r: random.Random, t: str, changes: int) -> str:
    w = t.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(WORDS) + "x"
    return " ".join(w)


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    r, docs = random.Random(seed), []
    hot = text(r, 70)
    for i in range(n):
        kind = r.random()
        if kind < 0.35 or not docs:
            t = text(r, r.randrange(1, 160))
        elif kind < 0.5:
            t = r.choice(docs)[1]
        elif kind < 0.75:
            t = near(r, r.choice(docs)[1] or "a", r.randrange(1, 4))
        else:
            t = text(r, r.randrange(5, 40)) + "\n" + hot + "\n" + text(r, 5)
        docs.append((i, t))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "one two")]


def frame(spark, docs):
    rows = [(i, t, "keep", i) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, _id long")


def test_components_match_all_pairs(spark):
    docs = corpus(1)
    for frequent in (64, 3):
        out = ngram_join.ngram_components(frame(spark, docs), frequent=frequent).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute.components(docs)


def test_components_of_large_near_copy_group(spark):
    """More near copies than a frequent shingle may have: the path by pivots and then by components."""
    r = random.Random(2)
    base = text(r, 120)
    docs = [(i, near(r, base, r.randrange(0, 5))) for i in range(130)] + [(200 + i, text(r, 30) + " " + base) for i in range(20)] + [(300, base), (301, base)]
    out = ngram_join.ngram_components(frame(spark, docs)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute.components(docs)


def test_crowds_of_several_clusters_by_rounds(spark, monkeypatch):
    """Clusters that share a long passage meet in one crowd; with rounds of pivots and without, all links are found."""
    r = random.Random(12)
    hot = text(r, 60)
    bases = [hot + " " + text(r, 9) for _ in range(6)]
    docs = [(i, near(r, bases[i % 6], r.randrange(0, 4))) for i in range(150)] + [(400 + i, hot + " " + text(r, 40)) for i in range(30)]
    expected = brute.components(docs)
    for plain in (0, 20):
        monkeypatch.setattr(ngram_join, "PLAIN", plain)
        out = ngram_join.ngram_components(frame(spark, docs), frequent=20).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == expected


def templated(r, n, passages, per=2, own=22, edits=0):
    """Texts of shared passages and words of their own; no two of them link."""
    out = []
    for i in range(n):
        parts = [p if not edits else near(r, p, edits) for p in r.sample(passages, per)]
        out.append((i, " ".join([" ".join(f"w{r.randrange(10**9)}" for _ in range(own)), *parts])))
    return out


def compared(spark, docs, **how):
    """(result, pairs that were compared in all) of one join."""
    from paperloom.llm.common import Scratch

    scratch = Scratch(spark)
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(frame(spark, docs), scratch=scratch, **how).collect()}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = [s.getPath().toString() for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root))]
    return out, sum(spark.read.parquet(t).count() for t in tables if t.rsplit("/", 1)[1].startswith(("tried_", "node_pairs", "links_", "pairs")))


def test_templates_do_not_make_squares(spark):
    """Texts that share two of twelve passages and link with nothing: twice the rows, about twice the work."""
    r = random.Random(21)
    passages = [" ".join(f"p{k}x{i}" for i in range(66)) for k in range(12)]
    sizes = {}
    for n in (300, 600):
        docs = templated(r, n, passages)
        out, sizes[n] = compared(spark, docs, frequent=20)
        assert all(c == i for i, (_, c) in out.items())
    assert sizes[600] <= 2.5 * sizes[300] + 200


def test_templates_with_edits_and_links_match_all_pairs(spark, monkeypatch):
    r = random.Random(22)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(5)]
    docs = templated(r, 90, passages, own=6) + [(100 + i, t) for i, t in templated(r, 60, passages, own=6, edits=1)] + [(200 + i, t) for i, t in templated(r, 60, passages, per=3, own=4)]
    docs += [(300 + i, near(r, docs[i * 3][1], 2)) for i in range(30)]
    expected = brute.components(docs)
    assert len({c for _, c in expected.values()}) < len(docs) - 20
    for plain in (0, 20):
        monkeypatch.setattr(ngram_join, "PLAIN", plain)
        assert compared(spark, docs, frequent=8)[0] == expected


def test_components_of_repeated_rows_and_nulls(spark):
    r = random.Random(3)
    t = text(r, 60)
    rows = [(5, t)] * 3 + [(None, t), (9, t), (None, None), (None, text(r, 30))]
    out = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in out) == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5), (5, 5), (9, 5)]
    assert ngram_join.ngram_components(frame(spark, rows).limit(0)).count() == 0


def test_spans_match_plain_version(spark):
    docs = [(i, t) for i, t in corpus(4) if t is not None]
    p = span_dedup.SpanParams()
    gone = brute.removed_sentences(docs, p.min_sentences, p.min_words, p.long_words)
    out = {x["doc_id"]: x for x in span_dedup.dedup_spans(frame(spark, docs)).collect()}
    assert len(out) == len(docs) and gone
    for i, t in docs:
        spans = [(s["start"], s["end"]) for s in out[i]["removed_spans"] or []]
        assert spans == gone.get(i, [])
        raw = t.encode()
        edges = [0, *(x for s in spans for x in s), len(raw)]
        assert out[i]["text"] == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
        assert out[i]["n"] == "keep"


def test_passage_of_one_long_sentence_is_found(spark):
    r = random.Random(8)
    passage = " ".join(r.choice(WORDS) + str(r.randrange(999)) for _ in range(60)) + "."
    docs = [(i, text(r, 40) + ".\n" + passage + "\n" + text(r, 40)) for i in range(3)]
    out = {x["doc_id"]: x for x in span_dedup.dedup_spans(frame(spark, docs)).collect()}
    assert passage in out[0]["text"] and passage[:100] not in out[1]["text"] and passage[:100] not in out[2]["text"]
    assert out[1]["first_id"] == 0


def test_span_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "short"), (3, "short")]
    out = span_dedup.dedup_spans(frame(spark, rows)).collect()
    assert sorted((x["doc_id"], x["text"] or "-") for x in out) == [(1, "-"), (2, "-"), (3, "short"), (3, "short")]
    assert span_dedup.dedup_spans(frame(spark, rows).limit(0)).count() == 0


def lines(r: random.Random, n: int) -> list[str]:
    return [text(r, 6).replace("\n", " ") for _ in range(n)]


def plain_cuts(rows, p):
    """The chunks again, each boundary hash made from scratch from the last lines' hashes."""
    import xxhash

    turned = lambda x, n: int(f"{x:064b}"[n:] + f"{x:064b}"[:n], 2)
    begin, out = 0, []
    for i in range(len(rows)):
        value = 0
        for back in range(min(p.window, i + 1)):
            value ^= turned(xxhash.xxh3_64_intdigest(rows[i - back].encode()), back)
        low = (value * 0x9E3779B97F4A7C15 % 2**64 >> 32) < int(2**32 * p.cut)
        if low or i + 1 - begin == p.max_lines or i + 1 == len(rows):
            out.append((begin, i + 1))
            begin = i + 1
    return out


def plain_line_dedup(docs, p):
    """Every chunk's bytes in order of documents; one seen before goes with the lines around it that agree with the first."""
    first, out = {}, {}
    for i, t in docs:
        out[i] = t
        if not t or "\n" not in t:
            continue
        rows, gone = t.split("\n"), set()
        cuts = plain_cuts(rows, p)
        for c, (a, b) in enumerate(cuts):
            body = tuple(rows[a:b])
            if not "".join(body).strip():
                continue
            other, x, y, low, high = first.setdefault(body, (rows, a, b, cuts[c - 1][0] if c else a, cuts[c + 1][1] if c + 1 < len(cuts) else b))
            if other is rows and x == a:
                continue
            left, right = a, b
            while left > (cuts[c - 1][0] if c else a) and x > low and rows[left - 1] == other[x - 1]:
                left, x = left - 1, x - 1
            while right < (cuts[c + 1][1] if c + 1 < len(cuts) else b) and y < high and rows[right] == other[y]:
                right, y = right + 1, y + 1
            if sum(bool(r.strip()) for r in rows[left:right]) > 1:
                gone |= set(range(left, right))
        out[i] = "\n".join(r for k, r in enumerate(rows) if k not in gone)
    return out


def test_line_dedup_matches_plain_version(spark):
    r, p = random.Random(6), line_dedup.LineChunkParams()
    shared = lines(r, 25)
    docs = []
    for i in range(40):
        own = lines(r, r.randrange(0, 12))
        at = r.randrange(len(own) + 1)
        docs.append((i, "\n".join(own[:at] + (shared if i % 3 == 0 else []) + own[at:])))
    docs += [(50, docs[1][1]), (51, docs[1][1]), (52, None), (53, ""), (54, "\n\n\n\n"), (55, "same\n" * 40)]
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert {i: x["text"] for i, x in out.items()} == plain_line_dedup(docs, p)
    assert out[3]["removed_lines"] > 10 and 0 in out[3]["first_ids"]
    assert out[50]["emptied"] == (out[50]["text"].strip() == "" and out[50]["removed_lines"] > 0)
    assert not out[53]["emptied"] and out[0]["n"] == "keep"


def test_boundaries_resist_shifts():
    r, p = random.Random(7), line_dedup.LineChunkParams()
    body = [x.encode() for x in lines(r, 60)]
    a = {b"\n".join(body[f : f + n]) for f, n in line_dedup.chunk_lines(body, p)}
    moved = [b"new one", b"new two", b"new three", *body]
    b = {b"\n".join(moved[f : f + n]) for f, n in line_dedup.chunk_lines(moved, p)}
    assert len(a & b) >= len(a) - 2


def test_line_dedup_of_repeated_rows(spark):
    t = "\n".join(lines(random.Random(9), 12))
    out = line_dedup.dedup_lines(frame(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    assert sorted((x["doc_id"] or -1, bool(x["removed_lines"])) for x in out) == [(-1, True), (1, False), (1, False), (2, True)]
    assert line_dedup.dedup_lines(frame(spark, [(1, t)]).limit(0)).count() == 0


def plain_repeated_lines(docs):
    """id -> lines that lie in two neighbouring lines that stood earlier, found without hashes or chunks."""
    seen, gone = set(), {}
    for i, t in docs:
        rows = t.split("\n")
        gone[i] = set()
        for j, pair in enumerate(zip(rows, rows[1:])):
            if pair in seen:
                gone[i] |= {j, j + 1}
            seen.add(pair)
    return gone


def test_query_finds_passages(spark, tmp_path):
    """Passages of 2 to 9 lines planted between a document's own lines: nine tenths of their lines go, no other line does."""
    from paperloom.llm import queries

    r, docs, planted = random.Random(17), [], {}
    for n in range(2, 10):
        for _ in range(6):
            passage = lines(r, n)
            for first in (True, False):
                own = lines(r, r.randrange(2, 8))
                at = r.randrange(len(own) + 1)
                docs.append((len(docs), "\n".join(own[:at] + passage + own[at:])))
                if not first:
                    planted[docs[-1][0]] = (own, passage)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {x["doc_id"]: x for x in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert set(out) <= set(planted) and all(x["first_id"] == i - 1 for i, x in out.items())
    assert all(set(own) <= set(out[i]["clean_text"].split("\n")) for i, (own, _) in planted.items() if i in out)
    assert sum(x["removed_lines"] for x in out.values()) >= 0.9 * sum(len(passage) for _, passage in planted.values())
    assert all(out[i]["removed_lines"] >= len(passage) - 1 for i, (_, passage) in planted.items() if len(passage) > 5)


def test_recall_comes_from_the_rolling_hash(spark):
    """On a corpus of copies, excerpts and own lines nine tenths of all repeated lines are found; without boundaries few are."""
    r, docs = random.Random(31), []
    for i in range(120):
        own = lines(r, r.randrange(1, 12))
        if docs and r.random() < 0.6:
            old = r.choice(docs)[1].split("\n")
            a = r.randrange(len(old))
            at = r.randrange(len(own) + 1)
            own = own[:at] + old[a : a + r.randrange(2, 14)] + own[at:]
        docs.append((i, "\n".join(own)))
    gone = plain_repeated_lines(docs)
    share = []
    for p in (line_dedup.LineChunkParams(), line_dedup.LineChunkParams(cut=0.0)):
        out = {x["doc_id"]: x["removed_lines"] for x in line_dedup.dedup_lines(frame(spark, docs), params=p).collect()}
        assert all(n <= len(gone[i]) for i, n in out.items())
        share.append(sum(out.values()) / sum(map(len, gone.values())))
    assert share[0] >= 0.9 and share[1] < 0.3


def test_the_first_of_each_line_stays(spark):
    r = random.Random(18)
    pool = lines(r, 12)
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(40)]
    docs += [(50, "same\n" * 9 + "same"), (51, "\n\nhead\n\nbody\n\n"), (52, "other\nhead\n\nbody")]
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert {x for _, t in docs for x in t.split("\n")} == {x for row in out.values() for x in row["text"].split("\n")} | {""}
    gone = plain_repeated_lines(docs[:40])
    assert all(out[i]["removed_lines"] <= len(gone[i]) for i in range(40)) and out[50]["text"].startswith("same")
