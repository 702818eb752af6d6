"""URL filter, length histogram, piece encoding, Merkle fingerprints, personal data: against brute force."""

import base64
import hashlib
import random
import re
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bytepair, lengths, merkle, pieces, pii, urls

DOCS = "doc_id bigint, text string"


@pytest.fixture()
def docs(spark):
    return lambda *texts, **more: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


# ---- URL filter


RULES = [urls.Rule("net", "/", False), urls.Rule("example.net", "/en/", True), urls.Rule("org", "/fr/", True)]


def test_hosts_paths_and_rules(spark):
    rows = [
        "http://A.Example.NET/en/1?x=/y", "https://example.net/EN/", "http://net", "http://xnet/a", "ftp://a.org/fr/#t",
        "no scheme/en/", None, "", "http://example.net:80/en/", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(rows)], "page_id long, url string, host string")
    model = urls.fit(urls.labels_from(pages, RULES))
    got = {r.page_id: r for r in urls.judge(pages, model, RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/EN/", "net/"), ("net", "", None), ("xnet", "/a", None),
        ("a.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("example.net:80", "/en/", None), ("b:", "//c/d", None),
    ]
    assert [got[i].verdict for i in (0, 1, 4, 6, 7)] == ["allow", "block", "allow", "block", "block"]
    assert got[6].score is None and got[7].score is None


def _brute_log_likelihood(counted, text):
    """Witten-Bell by dictionaries, one character at a time."""
    table = urls._class_table()
    codes = lambda u: [0] * urls.ORDER + [int(table[b]) for b in u.encode()] + [0]
    grams = {}
    for u in counted:
        c = codes(u)
        for i in range(urls.ORDER, len(c)):
            for k in range(urls.ORDER + 1):
                context = tuple(c[i - k : i])
                grams.setdefault(context, {}).setdefault(c[i], 0)
                grams[context][c[i]] += 1
    total, c = 0.0, codes(text)
    for i in range(urls.ORDER, len(c)):
        seen = grams[()]
        p = (seen.get(c[i], 0) + 0.5) / (sum(seen.values()) + 0.5 * urls.CLASSES)
        for k in range(1, urls.ORDER + 1):
            seen = grams.get(tuple(c[i - k : i]))
            if seen:
                p = (seen.get(c[i], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        total += np.log(p)
    return total / (len(c) - urls.ORDER)


def test_scores_are_those_of_the_models(spark):
    good, bad = [f"good{i}.org/fr/page" for i in range(40)], [f"casino-win{i}.com/x?y={i}" for i in range(40)]
    rows = [("http://" + u, True) for u in good] + [("http://" + u, False) for u in bad] + [(None, True), ("http://z", None)]
    labelled = spark.createDataFrame(rows, "url string, accepted boolean")
    model = urls.fit(labelled)
    held = {r.url for r in labelled.where(F.pmod(F.xxhash64("url"), F.lit(urls.HELD_OUT)) == 0).collect()}
    counted = lambda us: [u for u in us if "http://" + u not in held]
    asked = ["good7.org/fr/", "casino-win.com/", "é/", "a" * 5000]
    got = spark.createDataFrame([(u,) for u in asked], "url string").select(urls.score(F.col("url"), model.difference, spark)).collect()
    for u, row in zip(asked, got, strict=True):
        want = _brute_log_likelihood(counted(good), u) - _brute_log_likelihood(counted(bad), u)
        assert abs(row[0] - want) < 1e-4
    verdicts = urls.judge(spark.createDataFrame([("http://good99.org/fr/page",), ("http://casino-win77.com/x?y=1",)], "url string"), model)
    assert [r.verdict for r in verdicts.collect()] == ["allow", "block"]


def test_one_kind_of_label_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/fr/")], "page_id long, url string")
    model = urls.fit(urls.labels_from(pages, RULES))
    assert model.threshold == 0 and not model.difference.any()
    assert urls.judge(pages, model).first().verdict == "allow"
    assert urls.judge(pages.limit(0), urls.fit(urls.labels_from(pages.limit(0), RULES)), RULES).count() == 0


# ---- length histogram


def test_lengths_against_brute_force(spark):
    import tiktoken

    with open(lengths.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("t", pat_str=bytepair.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["tide", "log", "é", "日本", "<|endoftext|>", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", "", " " * 3000, "x" * 50_000, *texts[:5]]
    table = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], DOCS + ", n_docs long")
    sums = lengths.suffix_sums(lengths.length_histogram(table), span=7)
    sizes = [len(encoding.encode_ordinary(t or "")) for t in texts]
    rows = sums.collect()
    assert sorted(r.encoded_len for r in rows) == sorted(set(sizes))
    for r in rows:
        longer = [s for s in sizes if s >= r.encoded_len]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(r.encoded_len), len(longer), sum(longer))
        assert (r.docs_total, r.tokens_total) == (len(sizes), sum(sizes))
        assert r.truncated_total == sum(min(s, r.encoded_len) for s in sizes)
        assert abs(r.share_within - sum(s <= r.encoded_len for s in sizes) / len(sizes)) < 1e-12
    for r in lengths.at_limits(sums, [0, 10, 10**6]).collect():
        assert (r.docs_cut, r.truncated_total) == (sum(s > r.context_limit for s in sizes), sum(min(s, r.context_limit) for s in sizes))
    assert lengths.quantile(sums, 0.5) == sorted(sizes)[(len(sizes) + 1) // 2 - 1]


def test_no_lengths(spark, docs):
    assert lengths.suffix_sums(lengths.length_histogram(docs("x").limit(0))).count() == 0


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.VOCABULARY, "rb") as file:
        return pieces.Pieces(file.read())


def _brute_viterbi(vocabulary, text):
    """Best path by trying every piece at every position; the longest piece wins a tie."""
    chunk = pieces.MARK + text.replace(" ", pieces.MARK)
    table = {piece: (score, i) for piece, score, i in vocabulary.scored}
    longest = max(map(len, table))
    best = [(0, [])]
    for end in range(1, len(chunk) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            hit = table.get(chunk[start:end])
            if hit and (found is None or best[start][0] + hit[0] > found[0]):
                found = (best[start][0] + hit[0], best[start][1] + [hit[1]])
        if chunk[end - 1] not in table and (found is None or best[end - 1][0] + vocabulary.unknown > found[0]):
            found = (best[end - 1][0] + vocabulary.unknown, best[end - 1][1] + [vocabulary.byte_ids[b] for b in chunk[end - 1].encode()])
        best.append(found)
    return best[-1][1]


TEXTS = [
    "the tide comes in", "  two  spaces ", "tabs\tand\nlines\r\n", "日本語 𠀋𠀋 é ﬁ", "%%% $$$ ***", "x" * 300, "😀 mixed 😀words", "a", " ",
    "Ünïcödé 12345 [brackets]",
]


def test_pieces_against_brute_force(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text in TEXTS:
        out = array("i")
        encoder.encode(text, out)
        assert list(out) == _brute_viterbi(vocabulary, text), text


def test_round_trip_in_every_case(spark):
    texts = [*TEXTS, None, "", "▁", "a▁b ▁ c▁", " ▁ ", "\x00\x01", "word " * 20_000, *TEXTS[:2]]
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS + ", ids string")
    rows = pieces.decode(pieces.encode(table)).collect()
    assert len(rows) == len(texts)
    assert all(r.decoded == texts[r.doc_id] for r in rows)
    assert next(r.ids for r in rows if texts[r.doc_id] is None) is None
    assert pieces.decode(pieces.encode(table.limit(0))).count() == 0


def test_strange_ids_decode_to_nothing(spark):
    table = spark.createDataFrame([([400, -1, 10**6, None, 1],), ([],), (None,)], "ids array<int>")
    first, second, third = [r.decoded for r in pieces.decode(table).collect()]
    assert first and (second, third) == ("", None)


# ---- Merkle fingerprints


def test_edited_texts_and_next_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    monkeypatch.setattr(merkle, "GROUP", 2)
    rng = random.Random(3)
    ids = [*range(0, 40, 3), 10**12, -5, 7, 7]
    texts = {}
    rows = []
    for i in ids:
        text = rng.choice([None, "", "One. Two.\nThree\n\nFour" * rng.randrange(1, 9), "é" * rng.randrange(80)])
        rows.append((i, text or ""))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, DOCS)
    got = merkle.with_next(table, {"size": F.length})
    got = [(r.doc_id, r.text, r.next_text, r.next_size) for r in got.collect()]
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    want = [(*order[n], order[(n + 1) % len(order)][1]) for n in range(len(order))]
    assert sorted(got) == sorted((*w, len(w[2])) for w in want)
    assert merkle.with_next(table.limit(0), {}).count() == 0
    one = merkle.with_next(spark.createDataFrame([(None, "x")], DOCS), {}).first()
    assert one.next_text == "x"


def test_roots_and_branches(spark):
    text = "A one. A two.\nB one! B two?\n\nC. " + "long words " * 30
    changed = text.replace("B two", "B 2")
    table = spark.createDataFrame([(text, changed, text + "\n"), ("", "", "\n"), ("x", "y", " x")], "a string, b string, c string")
    a, b, c = (merkle.tree(F.col(n)) for n in "abc")
    rows = table.select(
        (merkle.root(a) == merkle.root(a)).alias("same"), (merkle.root(a) == merkle.root(c)).alias("other"),
        merkle.edits(a, b).alias("edits"), merkle.likeness(merkle.codes(a), merkle.codes(b)).alias("near"),
        merkle.fingerprint(a).alias("fa"), merkle.fingerprint(b).alias("fb"), merkle.root(a).alias("root"),
    ).collect()
    assert [r.same for r in rows] == [True] * 3 and [r.other for r in rows] == [False] * 3
    assert [(e.section, e.paragraph) for e in rows[0].edits] == [(0, 1)]
    assert 0.9 < rows[0].near < 1 and rows[1].near == 1 and rows[2].near == 0
    assert rows[1].fa == rows[1].fb and rows[0].fa != rows[0].fb
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections = [[digest(p) for p in s.split("\n")] for s in text.split("\n\n")]
    assert rows[0].root == digest("".join(digest("".join(s)) for s in sections)) == rows[0].fa[:64]


def test_a_long_text(spark):
    text = "word " * 200_000 + "\n" + "x" * 300_000
    row = spark.createDataFrame([(text,)], "t string").select(merkle.tree(F.col("t")).alias("t")).select(
        F.size(merkle.codes(F.col("t"))).alias("n"), merkle.likeness(merkle.codes(F.col("t")), merkle.codes(F.col("t"))).alias("near")
    ).first()
    assert row.n > 1 and row.near == 1


def brute_mark(text):
    """(root, sketch as sorted (code, n), reach) by the definition."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = [s.split("\n") for s in text.split("\n\n")]
    leaves = Counter()
    leaf = merkle.LEAF.replace(r"[\S&&[^", r"[^\s").replace("]]", "]")  # Python has no intersection of classes
    for piece in (m for s in sections for p in s for m in re.findall(leaf, p, re.ASCII)):
        low = xxhash.xxh64_intdigest(piece.encode(), 42) & ((1 << 33) - 1)
        leaves[low << 7 | min(len(piece), 127)] += 1
    ordered = sorted(leaves.items())
    return digest("".join(digest("".join(map(digest, s))) for s in sections)), ordered[: merkle.SKETCH + 1]


def brute_alike(a, b):
    (root_a, x), (root_b, y) = brute_mark(a), brute_mark(b)
    if root_a == root_b:
        return 1.0
    edge = min([z[-1][0] for z in (x, y) if len(z) > merkle.SKETCH], default=1 << 62)
    x, y = ({c: n for c, n in z if c < edge} for z in (x, y))
    both = sum((c & 127) * n for z in (x, y) for c, n in z.items())
    return 2 * sum((c & 127) * min(n, y.get(c, 0)) for c, n in x.items()) / both if both else 1.0


def test_likeness_counts_repeats_and_stays_small(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdensty", k=rng.randrange(1, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))
    line, long, unspaced = "The same line of words again.", words(40_000), "的一是不了人我在有他。" * 300 + "，".join("天地人" * 20)
    many = "\n\n".join(words(30) for _ in range(50))
    pairs = [
        ("\n".join([line] * 100), line), (long, long[:100_000] + " new " + long[100_000:]), (long, words(40_000)), (many, "x " + many),
        (unspaced, "她" + unspaced), (many, many[: len(many) // 2] + words(800)), ("", "\n"), ("", "a"), ("a b", "b a"), (long, ""), ("\t \x0b", "\u00a0\u2003"),
    ]
    a, b = (merkle.mark(merkle.tree(F.col(n))) for n in "ab")
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.alike(a, b).alias("near"), merkle.shown(a).alias("shown")).collect()
    got = {(r.a, r.b): r for r in rows}
    for pair in pairs:
        assert got[pair].near == pytest.approx(brute_alike(*pair)) and len(got[pair].shown) < 4096
    near = [got[p].near for p in pairs]
    assert near[0] < 0.1 and near[1] > 0.97 and near[2] < 0.2 and near[3] > 0.98 and near[4] > 0.9 and 0.4 < near[5] < 0.75


def test_first_edit(spark):
    text = "a\nb\n\nc\nd\n\ne"
    cases = [(text, None), ("a\nb\n\nc\nD\n\ne", (1, 1)), ("x" + text, (0, 0)), (text + "\nf", (2, 1)), (text + "\n\nf", (3, 0)), ("a", (0, 1)), ("", (0, 0))]
    table = spark.createDataFrame([(text, c) for c, _ in cases], "a string, b string")
    rows = table.select("b", merkle.first_edit(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("at")).collect()
    assert {r.b: r.at and tuple(r.at) for r in rows} == dict(cases)


@pytest.mark.parametrize("case", ["far", "null", "one", "dense"])
def test_buckets_stay_small(spark, case):
    some = spark.range(1, 20_001).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    more = {
        "far": spark.createDataFrame([(10**15, "x"), (-(10**15), "y")], DOCS),
        "null": some.withColumn("doc_id", F.lit(None).cast("bigint")),
        "one": some.withColumn("doc_id", F.lit(77).cast("bigint")), "dense": some.where("doc_id < 0"),
    }[case]
    table = some.union(more)
    bucket, _ = merkle._buckets(table, "doc_id", "text")
    held = table.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("b").collect()
    assert max(r.n for r in held) <= 2 * merkle.BUCKET_ROWS and sum(r.n for r in held) == table.count() and len(held) < 200
    edges = [(r.low, r.high) for r in held if r.low is not None]
    assert all(x[1] <= y[0] for x, y in zip(edges, edges[1:]))


def test_next_rows_of_a_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 4)
    monkeypatch.setattr(merkle, "GROUP", 2)
    rows = [(i, f"n{i}") for i in range(9)] + [(4, f"h{i}") for i in range(40)] + [(None, f"z{i}") for i in range(30)]
    got = {r.text: r for r in merkle.with_next(spark.createDataFrame(rows, DOCS), {}).collect()}
    ids = {t: i for i, t in rows}
    walk, at = [], "n8"
    for _ in rows:
        walk.append(at)
        at = got[at].next_text
    assert at == "n8" and sorted(walk) == sorted(ids)  # one cycle through all rows
    seen = [ids[t] for t in walk]
    assert seen == sorted((i for i, _ in rows if i is not None), reverse=True) + [None] * 30


# ---- personal data


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _brute_spans(text):
    found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", m.span()))
    return [(k, *s) for k, s in found]


def _card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    number = next(body + d for d in "0123456789" if _luhn(body + d))
    return " ".join(number[i : i + 4] for i in range(0, 16, 4))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    parts = [
        "a.b+c@x-y.org", "a@b.c_d@e.f", "a@b", "@x.y", "me@@you.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.0003.255", "999.9.9.9.1.1.1",
        "+1 (386) 555-3733", "+12", "+49--30 1234567.", "++4912345678901", "4111 1111 1111 1111", "4111-1111-1111-1112", "12 34", "é", "日本", "😀", " ", ",", "\n", "x", "7",
    ]
    texts = ["".join(rng.choice(parts + [_card(rng)]) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["", "1" * 20_000, "a" * 50_000 + "@x.y", "1 " * 20_000, "+1" + "(" * 20_000, "1." * 20_000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    for row in table.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect():
        want = _brute_spans(texts[row.doc_id])
        assert [(s.kind, s.start, s.end) for s in row.s] == want, texts[row.doc_id][:200]
        assert all(texts[row.doc_id][s.start : s.end] == s.value for s in row.s)


def _brute_terms(texts, disclose=pii.DISCLOSE, remove=pii.REMOVE):
    """Terms of every text with their places: the definition, text by text."""
    at = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    word = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
    rows, counts, total = {}, Counter(), 0
    for text in texts:
        text = text or ""
        clean = at.sub(lambda m: " " * len(m[0]), text)
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(clean) if len(m[0]) >= 3]
        counts.update(w for _, _, w in words)
        total += len(words)
        names = {(k, text[a:b].lower()) for k, a, b in _brute_spans(text)}
        if names:
            rows[text] = (words, names, rows[text][2] + 1 if text in rows else 1)
    n_e, n_et, contexts = Counter(), Counter(), {}
    for words, names, copies in rows.values():
        for e in names:
            n_e[e] += copies * len(words)
            for _, _, w in words:
                n_et[e, w] += copies
                contexts.setdefault((e, w), set()).add(tuple(w for _, _, w in words))
    acts = {}
    for (e, w), n in n_et.items():
        lower = n * (1 - 1 / len(contexts[e, w]) ** 0.5)
        if lower > 0 and n_e[e] < total:
            share = np.log2(total * lower / (counts[w] * n_e[e])) / np.log2(total / n_e[e])
            assert abs(share - disclose) > 1e-9 and abs(share - remove) > 1e-9
            if share >= disclose:
                acts[e, w] = "remove" if share >= remove else "generalise"
    return [
        [(a, b, max(found)) for a, b, w in rows[t or ""][0] if (found := [acts[e, w] for e in rows[t or ""][1] if (e, w) in acts])]
        if (t or "") in rows else [] for t in texts
    ]


def _found_terms(spark, texts, **options):
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5), **options).collect()}
    assert len(rows) == len(texts)
    return [[(t.start, t.end, t.act) for t in rows[i].terms] for i in range(len(texts))]


def _crowd(seed, people=12, size=700):
    """Texts of common words; people whose names stand by their addresses, some always, some at times; copies."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = []
    for n in range(size):
        words = [rng.choice(common) for _ in range(rng.randrange(4, 14))]
        for p in {rng.randrange(people) for _ in range(rng.choice((0, 0, 0, 1, 1, 2)))}:
            words.insert(rng.randrange(len(words)), f"P{p}@mail.org" if p % 3 else f"10.0.0.{p}")
            if rng.random() < (1, 0.9, 0.5)[p % 3]:
                words.insert(rng.randrange(len(words)), rng.choice(("Namo", "<namo>", "'NAMO'")).replace("o", "o" * (p + 1)).replace("O", "O" * (p + 1)))
        if rng.random() < 0.1:
            words.append("rare" + "".join(rng.choice("xyz") for _ in range(8)))
        texts.append(" ".join(words))
    return texts + texts[:30] + ["", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_against_brute_force(spark, seed):
    texts = _crowd(seed)
    want = _brute_terms(texts, remove=0.9)
    assert sum(map(len, want)) > 50 and {act for row in want for *_, act in row} == {"generalise", "remove"}
    assert _found_terms(spark, texts, remove=0.9) == want


def _corpus():
    """One address that a rare name stands by in eight contexts, and much else."""
    near = ["write to {} Zebulon now", "ask Zebulon at {} today", "Zebulon has {} for long", "today write {} Zebulon here"]
    rows = [f"filler words stand here {n}. {'more ' * (n // 4)}" + near[n % 4].format("zeb@mail.org") + " and more filler words follow" for n in range(8)]
    rows += [f"common words about nothing, write now and ask today {n} x{n}@mail.org Oncename{chr(97 + n)} here" for n in range(25)]
    rows += ["Zebulon alone is not near anything here", None, "", rows[0]]
    return rows + [f"filler words stand here {n}. write to nobody now and more filler words follow" for n in range(1500)]


def test_terms_that_reveal_an_address(spark):
    texts = _corpus()
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS + ", spans string")
    rows = {r.doc_id: r for r in pii.find(table).collect()}
    assert len(rows) == len(texts)
    for i in (*range(8), 36):
        assert [texts[i][t.start : t.end] for t in rows[i].terms] == ["Zebulon"], i
    # a rare word next to one address by chance stays
    assert all(not rows[i].terms for i in range(8, 36))
    assert not rows[34].spans and not rows[35].spans
    out = {r.doc_id: r for r in pii.sanitise(table).collect()}
    assert out[0].text == "filler words stand here 0. write to [EMAIL] [TERM] now and more filler words follow"
    assert out[33].text == texts[33] and out[34].text is None and out[0].spans == "clash"


def test_terms_far_from_the_address_and_in_brackets(spark):
    far = "and other words go on, " * 12
    texts = [f"ask Zebulon {'abcdefghij'[n] * 4}. {far}zeb@mail.org {far}<Zebulon> and 'Zebulon' (\"Zebulon\") é😀 [Zebulon]{'.' * n}" for n in range(10)]
    texts += [f"ask nobody else of it. {far}<nobody> {n}" for n in range(800)]
    rows = _found_terms(spark, texts)
    assert rows == _brute_terms(texts)
    assert all([texts[i][a:b] for a, b, _ in rows[i]] == ["Zebulon"] * 5 for i in range(10)) and not any(rows[10:])


def test_one_context_tells_nothing_whatever_the_size(spark):
    texts = ["ask Zebulon at zeb@mail.org today", *["write to Abimelech at abi@mail.org now"] * 5, "ask nobody at x@mail.org today"]
    texts += [f"ask nobody at all today, write to nobody now {n}" for n in range(2000)]
    assert not any(_found_terms(spark, texts))


def test_pairs_do_not_grow_with_places(spark):
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200))
    texts = [" ".join(f"a{i}@b.org" for i in range(100)) + " " + words * 2, *[f"a{i}@b.org {words[: 5 * i]}" for i in range(100)]]
    table = spark.createDataFrame(list(enumerate(texts + ["some other words " * 30] * 50)), DOCS)
    counts = pii.word_counts(table)
    total = counts.agg(F.sum("n")).first()[0]
    pairs = pii.term_pairs(pii._texts(table, "text"), counts, total)
    # every address has two contexts and terms of its own: one row a context, entity and distinct term at most
    assert pairs.groupBy("entity", "context", "term").count().where("count > 1").count() == 0
    assert pairs.where(F.col("n_t") > F.col("n_e") * F.pow(total / F.col("n_e"), F.lit(0.15)) + 1).count() == 0


def test_places_of_many_matches(spark):
    text = "é😀ab, x" * 1000
    (row,) = spark.createDataFrame([(0, text)], DOCS).select(pii._located(F.col("text"), pii.WORD).alias("w")).collect()
    assert [(w.start, w.end, w.value) for w in row.w] == [(m.start(), m.end(), m.group()) for m in re.finditer("[a-zé]+", text)]


def test_revealing_terms_by_hand(spark):
    pairs = spark.createDataFrame(
        [("e", c, "t", 1, 8, 4) for c in range(4)] + [("e", 1, "u", 5, 8, 5), ("f", 9, "t", 1, 1, 4)],
        "entity string, context int, term string, m long, n_e long, n_t long",
    )
    got = pii.revealing_terms(pairs, 1000, disclose=0.5).collect()
    want = np.log2(1000 * 2 / (4 * 8)) / np.log2(1000 / 8)
    assert [(r.entity, r.term) for r in got] == [("e", "t")] and abs(got[0].share - want) < 1e-12


def test_overlapping_spans_are_replaced_together(spark):
    texts = ["call +4222222222222 now", "a@b.org", "x a@b.org y c@d.org", ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    out = [r.text for r in pii.sanitise(table).orderBy("doc_id").collect()]
    assert out[1:] == ["[EMAIL]", "x [EMAIL] y [EMAIL]", ""] and out[0] == "call [PHONE] now"
    assert pii.find(table.limit(0)).count() == 0


