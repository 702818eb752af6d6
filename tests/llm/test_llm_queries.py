"""The registered queries and the pipeline on small tables with every kind of odd row, against brute force."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_corpus_operators import brute_components, brute_top, near_docs
from tests.llm.test_sequence_operators import brute_infill, brute_trie, check_packing
from tests.llm.test_text_operators import _brute_spans, _brute_terms, brute_alike
from tidelog.llm import bytepair, lengths, mixing, packing, pieces
from tidelog.session import configure

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    names = ("documents", "pages", "embeddings", "labels", "conversations")
    rows = {n: con.execute(f"SELECT * FROM '{SMALL}/{n}.parquet'").fetchall() for n in names}
    docs = [(i, t, lang, source) for i, t, lang, source, _ in rows["documents"][:120]]
    docs += [(1000 + i, t, "en", "src0") for i, t in near_docs()]
    docs += [(2000, None, None, None), (2001, "", "en", "src1"), (2002, "mail a@b.org and 10.0.0.1, card 4111 1111 1111 1111, +1 (386) 555-3733", "de", None)]
    # a name that stands by one address in many texts
    docs += [(3000 + i, f"{t} Write to Quillon at quill@mail.org today.", lang, source) for i, t, lang, source, _ in rows["documents"][130:165]]
    rows["documents"] = [(*d, len(d[1] or "")) for d in docs]
    rows["pages"] += [(5000, None, None), (5001, "", ""), (5002, "HTTP://Sub.EXAMPLE.net/en/x?y#z", "é" * 700), (5003, "ftp://a.example.net", "é" * 700)]
    rows["embeddings"] = rows["embeddings"][:160] + [(9000, None, 0), (9050, [0.0] * 64, 1), (9050, [0.0] * 64, 1)]
    rows["conversations"] = rows["conversations"][:80] + [(None, 0, "user", "x"), (71, None, None, None), (71, 0, "user", "é"), (72, 3, "", "")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    kinds = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "pages": "page_id bigint, url string, html string",
        "embeddings": "vec_id bigint, embedding array<float>, label int", "labels": "doc_id bigint, quality int, toxic int",
        "conversations": "conv_id bigint, turn bigint, role string, text string",
    }
    for name, kind in kinds.items():
        spark.createDataFrame(tables[name], kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "embeddings", "labels", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def rows_of(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_url_verdicts(spark, folder, tables):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = {r.page_id: r for r in rows_of(spark, folder, "op1_url_filter")}
    assert len(got) == len(tables["pages"])
    for page, url, _ in tables["pages"]:
        _, mark, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest, maxsplit=1)[0].lower() if mark else ""
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0] if mark else ""
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, got[page].verdict)
        assert (got[page].host, got[page].path, got[page].rule, got[page].verdict) == (host, path, rule, verdict) and verdict in ("allow", "block")


def test_archived_pages(spark, folder, tables):
    data = {page: (html or "").encode() for page, _, html in tables["pages"]}
    for r in rows_of(spark, folder, "op2_warc"):
        own = data.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(own), hashlib.sha1(own).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5003) if r.page_id == 5002 else ("response", None))
    assert not data


def test_fingerprints(spark, folder, tables):
    order = sorted(((d[0], d[1] or "") for d in tables["documents"]), reverse=True)
    got = {r.doc_id: r for r in rows_of(spark, folder, "op4_merkle")}
    assert len(got) == len(order)
    by_text = {}
    for n, (doc, text) in enumerate(order):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + order[(n + 1) % len(order)][1][:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(brute_alike(text, changed)) and (r.near_edited == 1 or text != changed)
        assert r.near_next == pytest.approx(brute_alike(text, order[(n + 1) % len(order)][1])) and (r.first_edit is None) == (text == changed)
        by_text.setdefault(text, set()).add(r.fingerprint)
        by_text.setdefault(changed, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_personal_data(spark, folder, tables):
    got = {r.doc_id: r for r in rows_of(spark, folder, "op5_pii")}
    terms = _brute_terms([d[1] for d in tables["documents"]])
    assert any(terms)
    for (doc, text, *_), more in zip(tables["documents"], terms, strict=True):
        spans = _brute_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r, kinds = got[doc], Counter(k for k, _, _ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans == ",".join([*([listed] if listed else []), *[f"term:{a}:{b}" for a, b, _ in more]])
    assert got[2002].n_email == got[2002].n_ip == got[2002].n_card == got[2002].n_phone == 1


def test_lengths_and_mix_cover_the_table(spark, folder, tables):
    sizes = rows_of(spark, folder, "op3_length_histogram")
    assert sum(r.n_docs for r in sizes) == len(tables["documents"]) == sizes[0].docs_total
    rows = rows_of(spark, folder, "op6_mixing")
    assert {r.doc_id for r in rows} == {d[0] for d in tables["documents"]}
    # quotas by the definition: the flattest powers of the shares whose repetition stays within the limit
    with open(lengths.VOCABULARY, "rb") as file:
        encoder = bytepair.encoder_of(file.read(), bytepair.PATTERN)
    size, largest, total = {}, Counter(), Counter()
    for doc, text, _, source, _ in tables["documents"]:
        size[doc] = encoder.count(text or "")
        total[source] += size[doc]
        largest[source] = max(largest[source], size[doc])
    assert all(r.tokens == size[r.doc_id] for r in rows)
    ratio = max(total.values()) / min(t for t in total.values() if t)
    x = max(0.0, 1 - math.log(mixing.REPEAT_LIMIT) / math.log(ratio))
    z = sum(t**x for t in total.values() if t)
    budget = math.ceil(mixing.REPEAT_LIMIT * total.total())
    have, places = Counter(), {}
    for r in rows:
        have[r.source] += r.tokens
        places.setdefault((r.source, r["pass"], r.block), set()).add(r.position)
    for source, t in total.items():
        if t:
            quota = budget * t**x / z
            assert quota >= t - 1 and quota - largest[source] - 1 <= have[source] <= quota + 1
    # a block has one place in its pass, and passes come one after the other
    assert all(len(p) == 1 and 0 <= min(p) < 1 for p in places.values())
    for source, n, block in places:
        for other in (k for k in places if k[0] == source and k[1] < n):
            assert min(places[other]) < min(places[source, n, block])


def test_nearest_vectors(spark, folder, tables):
    got = [tuple(r) for r in rows_of(spark, folder, "op7_top_k")]
    assert set(got) == brute_top([(i, v) for i, v, _ in tables["embeddings"]], lambda i: i % 50 == 0, 5) and len(got) == len(set(got))


def test_pieces_come_back(spark, folder, tables):
    got = {r.doc_id: r for r in rows_of(spark, folder, "op8_pieces")}
    assert len(got) == len(tables["documents"]) and all(r.round_trip for r in got.values())
    for doc, text, *_ in tables["documents"]:
        assert got[doc].decoded_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text is not None else None)


def test_near_duplicates(spark, folder, tables):
    got = rows_of(spark, folder, "op9_near_duplicates")
    assert {tuple(r) for r in got} == brute_components([d[:2] for d in tables["documents"]])


def test_quality(spark, folder, tables):
    got = {r.doc_id: r for r in rows_of(spark, folder, "op10_quality")}
    assert len(got) == len(tables["documents"])
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)


def test_prefix_trie(spark, folder, tables):
    got = [tuple(r) for r in rows_of(spark, folder, "op11_prefix_trie")]
    assert set(got) == brute_trie(tables["conversations"]) and len(got) == len(set(got))


def test_infill(spark, folder, tables):
    got = {r.doc_id: r for r in rows_of(spark, folder, "op12_infill")}
    assert len(got) == len(tables["documents"])
    for doc, text, *_ in tables["documents"]:
        n, form, low, high, output = brute_infill(doc, text)
        want = (n, form, low, None if low is None else high - low, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        r = got[doc]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == want


def test_packing(spark, folder, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    got = rows_of(spark, folder, "op13_packing")
    used = check_packing(got, 2048)
    total = 0
    for doc, text, *_ in tables["documents"]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want = [(n, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc) == want
    assert used <= -(-total // 2048) * 1.05 + 1


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match("op[0-9]+_|pipeline", n)))
def test_empty_tables(spark, empty, name):
    assert rows_of(spark, empty, name) == []


def test_pipeline_against_brute_force(spark, folder, tables):
    configure(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, folder).collect()}
    clean = [d for d in tables["documents"] if d[0] in good]
    kept = {i for i, _, _, keeps in brute_components([d[:2] for d in clean]) if keeps}
    with open(pieces.VOCABULARY, "rb") as file:
        encoder = pieces.Encoder(pieces.Pieces(file.read()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == kept and len(got) >= len(kept)
    left = {d[0]: d[1] for d in clean if d[0] in kept}
    terms = dict(zip(left, _brute_terms(list(left.values())), strict=True))
    assert sum(map(len, terms.values())) >= 5
    for r in got:
        text = left[r.doc_id]
        spans = [(a, -b, f"[{k.upper()}]") for k, a, b in _brute_spans(text or "")]
        spans += [(a, -b, "" if act == "remove" else "[TERM]") for a, b, act in terms[r.doc_id]]
        out, at = "", 0
        for a, b, mark in sorted(spans):
            if a >= at:
                out += text[at:a] + mark
            at = max(at, -b)
        ids = array("i")
        encoder.encode(out + (text or "")[at:], ids)
        assert (r.ids or []) == list(ids) and r.n_tokens == len(ids)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
