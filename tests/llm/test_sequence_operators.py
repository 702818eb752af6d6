"""Prefix trie, infilling and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bytepair, eulertour, infill, lengths, packing
from tidelog.llm.queries import SHARED_MOST

# ------------------------------------------------------------------ prefix trie


def brute_trie(rows):
    """Nodes by the contract of query 11; equal turns may come in any order."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (SHARED_MOST + 1)
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for path, convs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out.add((min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("x"))
    turns = eulertour.turns_in_order(df)
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string")) % (SHARED_MOST + 1)
    return {tuple(r) for r in eulertour.prefix_trie(eulertour.branch(turns, conv - conv % 5, shared, SHARED_MOST)).collect()}


def test_trie_with_odd_rows(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), 103, 1004, 1_000_000_007]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn if turn else rng.choice([None, 0]), rng.choice(["user", None, ""]), rng.choice(["hi", "é漢", "", None, "a longer text"])))
    rows += [(None, 0, "user", "belongs to none"), (60, 0, "user", "same"), (60, 1, "user", "same"), (61, 0, "user", "x")]
    rows += [(70, turn, "user", str(turn)) for turn in range(40)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_repeated_turns_and_one_conversation(spark):
    rows = [(5, 0, "a", "b")] * 3 + [(6, 0, "a", "b")] * 3
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, [(3, None, None, None)]) == brute_trie([(3, None, None, None)])
    assert trie_of(spark, []) == set() and trie_of(spark, [(None, 1, "a", "b")]) == set()


@pytest.mark.parametrize("sparse, few", [(5, 12), (64, 10_000)])
def test_list_ranks(spark, sparse, few):
    order = list(range(300))
    random.Random(sparse).shuffle(order)
    lists = [order[:200], order[200:299], order[299:]]
    rows = [(a, b) for part in lists for a, b in zip(part, [*part[1:], None])]
    got = {r.arc: r.to_end for r in eulertour.list_rank(spark.createDataFrame(rows, "arc bigint, next bigint"), sparse, few).collect()}
    assert got == {arc: len(part) - 1 - n for part in lists for n, arc in enumerate(part)}


# ------------------------------------------------------------------ infilling


def brute_infill(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * n : 8 * n + 8], 16) for n in range(4))
    n = len(text)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or three % 100 >= 90:
        return n, "plain", None, None, text
    before, middle, behind = text[:low], text[low:high], text[high:]
    if four % 100 < 20:
        return n, "spm", low, high, f"<S>{behind}<P>{before}<M>{middle}"
    return n, "psm", low, high, f"<P>{before}<S>{behind}<M>{middle}"


def test_infill_against_slices(spark):
    texts = ["", None, "a", "ab", "漢字かな", "é" * 70_000, "x<P", "<S", "has <M> in it", "a\x00b", "😀" * 3, "  \n ", "ab漢" * 60_000]
    rows = [(n, texts[n % len(texts)]) for n in range(130)] + [(None, "no key"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("a column of the name of a result"))
    out = infill.transform(docs, "doc_id")
    got = out.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.low, r.high, r.output) == brute_infill(r.doc_id, r.text) and r.back == (r.text or "")
    assert infill.transform(docs.where("false"), "doc_id").count() == 0


def test_other_units_and_marks(spark):
    docs = spark.createDataFrame([(n, "one two  three\nfour") for n in range(60)], "doc_id bigint, text string")
    marks = infill.Marks("[pre]", "{suf}", "|mid")
    out = infill.transform(docs, "doc_id", keep_plain=0, marks=marks, pattern=r"\S+")
    rows = out.withColumn("back", infill.restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.n for r in rows} == {7} and all(r.back == r.text for r in rows)
    assert all(r.output.split("|mid")[1].strip() in ("", "one", "two", "three", "four") or r.high - r.low > 1 for r in rows)
    for wrong in (infill.Marks("<P>", "<P>", "<M>"), infill.Marks("<P>", "", "<M>"), infill.Marks("aa", "b", "c"), infill.Marks("<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.transform(docs, "doc_id", marks=wrong)


def test_boundary_containers():
    rng = np.random.default_rng(0)
    mixed = "".join(rng.choice(list("aé漢😀"), 90_000).tolist())
    for text, kinds in (("x" * 200_000, {"runs"}), ("漢" * 90_000, {"bitmap"}), (mixed, {"bitmap"}), ("é" * 9, {"array"}), ("", {"array"})):
        bounds = infill.code_points(text.encode())
        assert len(bounds) == len(text) + 1 and kinds <= {c.kind for c in bounds.containers}
        for k in [0, len(text), *(int(k) for k in rng.integers(0, len(text) + 1, 40))]:
            assert bounds.select(k) == len(text[:k].encode())
    bounds = infill.units("ab  é漢 x".encode(), r"\w+")
    assert [bounds.select(k) for k in range(len(bounds))] == [0, 2, 4, 9, 10, 11]


# ------------------------------------------------------------------ packing


def brute_sum_of_squares(lengths, capacity):
    bins = []
    for size in lengths:
        counts = np.bincount(bins, minlength=capacity + 1)
        options = [(int((np.bincount([*bins, capacity - size], minlength=capacity + 1)[1:] ** 2).sum()), capacity)]
        for gap in sorted({b for b in bins if b >= size and b}):
            after = counts.copy()
            after[gap] -= 1
            after[gap - size] += 1
            options.append((int((after[1:] ** 2).sum()), gap))
        gap = min(options)[1]
        if gap == capacity:
            bins.append(capacity - size)
        else:
            bins[bins.index(gap)] -= size
    return sorted(bins)


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(2)
    for capacity in (1, 2, 10, 37):
        lengths = rng.integers(1, capacity + 1, 120)
        chosen, offsets, free = packing.sum_of_squares(lengths, capacity)
        assert sorted(free.tolist()) == brute_sum_of_squares(lengths.tolist(), capacity)
        for number in range(len(free)):
            inside = np.flatnonzero(chosen == number)
            assert offsets[inside].tolist() == np.concatenate([[0], np.cumsum(lengths[inside])])[:-1].tolist()
            assert lengths[inside].sum() == capacity - free[number]


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("group", [400, 100_000])
def test_places(spark, group):
    rng = random.Random(1)
    lengths = [rng.randrange(1, 101) for _ in range(900)] + [100] * 30 + [7] * 300
    df = spark.createDataFrame([(n % 3, size) for n, size in enumerate(lengths)], "doc_id bigint, length bigint")
    rows = packing.place(df, 100, group).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert check_packing(rows, 100) <= -(-sum(lengths) // 100) * 1.05 + 2
    assert packing.place(df.where("false"), 100, group).count() == 0
    # nothing fits together: one sequence each, whatever the number of rounds
    halves = df.where("length > 50").select("doc_id", F.lit(60).cast("bigint").alias("length"))
    assert packing.place(halves, 100, group).select("sequence_id").distinct().count() == halves.count()


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    tokenizer.encode_special_tokens = True
    texts = ["", None, "one two", "two  spaces", " <|endoftext|> x", "a\r\nb\tc\n\nd ", "don't  stop", "é漢 字", "word " * 200, " " * 5_000, "x" * 3_000, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    packed = packing.place(packing.cut(docs, ["doc_id"], capacity=64), 64)
    rows = packed.collect()
    check_packing(rows, 64)
    for doc, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in rows if r.doc_id == doc)
        assert [p[0] for p in own] == list(range(len(own))) and all(p[2] == 64 for p in own[1:])
        assert b"".join(p[3] for p in own) == np.array(ids, "<u4").tobytes()
        assert [p[1] for p in own] == np.concatenate([[0], np.cumsum([p[2] for p in own])])[:-1].tolist()
        assert all(zlib.crc32(p[3]) == p[4] for p in own)
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.length <= 256 for r in whole)


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    tokenizer.encode_special_tokens = True
    with open(packing.VOCABULARY, "rb") as file:
        encoder = bytepair.Encoder(file.read())
    rng = random.Random(1)
    parts = [" ", "\n", "\t", "\r\n", "  ", "a", "é", "’", "'s", "'", ".", "1", "漢", "\u2009", "\u3000", "\xa0", "\x1c", "\x85", "<|endoftext|>", "don't"]
    parts += ["\u200b", "— ", " " * 1_500, "\n" * 1_023, "\u3000" * 1_100]
    long = ["word é " * 100_000, "\n" * 300_000, "x" * 50_000, "a" + " " * 200_000 + "b"]
    for text in [*("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3_000)), *long]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes() and encoder.count(text) == len(ids)


def test_lengths_of_blank_texts(spark):
    texts = [" " * 5_000_000, "\n" * 5_000_000, "a" + "\t " * 1_000_000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    with open(lengths.VOCABULARY, "rb") as file:
        encoder = bytepair.Encoder(file.read())
    got = {r.encoded_len: r.n_docs for r in lengths.length_histogram(docs).collect()}
    assert got == dict(Counter(encoder.count(t) for t in texts)) and max(got) == 5_000_000
