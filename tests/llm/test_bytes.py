import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.cases import empty_docs, odd_docs, odd_texts
from tidymesh.llm import queries as Q
from tidymesh.llm.byte_bpe import decode_bpe, encode_bpe, load_ranks
from tidymesh.llm.packing import Effort, Tokens, best_fit, bin_completion, cut, fillings, pack_documents
from tidymesh.llm.warc import SEGMENT, framed, read_warc, records, round_trip, unframed, write_warc

MULTI = tok.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=load_ranks(MULTI), special_tokens={})


def test_bpe_as_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op10_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd(spark, library):
    rng = random.Random(3)
    texts = [*odd_texts(), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), " " * 700 + "ab" * 400, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS decoded")
    got = decode_bpe(encode_bpe(df, MULTI, tok.PATTERN), MULTI, tok.PATTERN).collect()
    for r in got:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert len(got) == len(texts)
    assert encode_bpe(empty_docs(spark), MULTI, tok.PATTERN).count() == 0


def held(patterns, capacity):
    got = Counter()
    for filling, n in patterns:
        assert sum(filling) <= capacity and n > 0
        for s in filling:
            got[s] += n
    return got, sum(n for _, n in patterns)


def fewest(items, capacity):
    """The optimum of many instances (a row each) at once: for each subset the fewest bins, and of these the emptiest last one."""
    n = items.shape[1]
    key = np.full((1 << n, len(items)), 1 << 40)
    key[0] = capacity  # no bin, and no room in it
    each = capacity + 1
    for subset in range(1, 1 << n):
        for i in range(n):
            if subset >> i & 1:
                before, size = key[subset ^ (1 << i)], items[:, i]
                after = np.where(before % each + size <= capacity, before + size, (before // each + 1) * each + size)
                np.minimum(key[subset], after, out=key[subset])
    return key[-1] // each


@pytest.mark.parametrize("capacity, least, most, n", [(100, 10, 55, 11), (100, 1, 100, 11), (60, 5, 40, 10), (30, 1, 15, 11), (17, 1, 17, 8)])
@pytest.mark.parametrize("steps", [None, 4_000_000])
def test_bin_completion_brute(capacity, least, most, n, steps):
    items = np.random.default_rng(capacity + n).integers(least, most + 1, (1000, n))
    for row, best in zip(items.tolist(), fewest(items, capacity)):
        got, bins = held(bin_completion(Counter(row), capacity, steps), capacity)
        assert got == Counter(row) and bins == best


def test_undominated():
    sizes = np.bincount([14, 25, 28, 31, 34, 37, 42, 43, 44, 44], minlength=101)
    assert [x for x in fillings(sizes, 51, 51, Effort(None))] == [(37, 14), (44,)]
    _, bins = held(bin_completion(Counter([14, 25, 28, 31, 34, 37, 42, 43, 44, 44, 49]), 100), 100)
    assert bins == 4
    sizes = np.bincount([3, 3, 2, 1], minlength=11)
    assert [x for x in fillings(sizes, 9, 9, Effort(None))] == [(3, 3, 2, 1)] and not [x for x in fillings(sizes, 12, 2, Effort(None))]


def test_bin_completion_beats_best_fit():
    counts = Counter([7, 6, 5, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 2]) + Counter({44: 3, 24: 3, 22: 3, 21: 3, 17: 3, 8: 3, 11: 3, 53: 1})
    _, most = held(best_fit(counts, 100), 100)
    _, n = held(bin_completion(counts, 100), 100)
    assert n <= most
    assert bin_completion({}, 10) == [] and bin_completion({3: 0}, 10) == []
    with pytest.raises(ValueError):
        bin_completion({11: 1}, 10)
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(1, 4) == [(0, 1)]


def check_packing(rows, texts, capacity=1024):
    full = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = full.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_ids_fuzz():
    """The quicker library's ids are those of the tokenizers library."""
    coder, full = Tokens(tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN), Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    pools = [(32, 127), (32, 0x250), (0x370, 0x530), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (9, 33), (0x2000, 0x2070)]
    for _ in range(20_000):
        parts = []
        for _ in range(rng.randint(1, 5)):
            lo, hi = rng.choice(pools)
            parts.append("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randint(1, 8))))
        text = rng.choice(["", " ", "\n", "'s"]).join(parts)
        assert coder.ids(text) == full.encode(text, add_special_tokens=False).ids


def test_packing_one_length(spark):
    """A third of all pieces of one length, and repeated rows, still get places of their own."""
    args = (tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    docs = spark.range(60_000).selectExpr("id % 50000 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text here' ELSE repeat('a b ', int(id % 40)) END AS text")
    packed = pack_documents(docs, *args, capacity=32, content="crc32")
    places = packed.selectExpr("sequence_id", "explode(sequence(offset, offset + length - 1)) AS at").groupBy("sequence_id", "at").count()
    assert places.where("count > 1 OR at >= 32").count() == 0
    assert packed.count() >= 60_000


def test_packing(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, bound = check_packing(Q.op5_best_fit_packing(spark, sf_dir).collect(), texts)
    assert n <= bound + 1


def test_packing_odd(spark):
    args = (tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    texts = [*odd_texts(), "a<|endoftext|>b <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS piece", "'x' AS length")
    check_packing(pack_documents(df, *args, content="crc32").collect(), dict(enumerate(texts)))
    ids = pack_documents(odd_docs(spark), *args, capacity=64).collect()
    assert all(len(r.ids) == r.length <= 64 for r in ids)
    assert pack_documents(empty_docs(spark), *args).count() == 0


def test_warc(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = Q.op7_warc(spark, sf_dir).collect()
    assert sum(len(x) > SEGMENT for x in pages.values()) > 10  # so ordinary pages are put together from segments
    assert sorted(r.page_id for r in rows) == sorted(pages)
    check_warc(rows, pages)


def check_warc(rows, pages):
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in rows:
        body = pages[r.page_id]
        again = len(body) >= 100 and first[body] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if again else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())


def test_warc_odd(spark, tmp_path):
    texts = ["", None, "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20, "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é😀" * 700_000, "é😀" * 700_000, "y" * 3_000_000, "\0\n" * 200]
    df = spark.createDataFrame([(i, "http://a/\n b", t) for i, t in enumerate(texts)], "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "2 AS page")
    rows = round_trip(df, path=f"{tmp_path}/w").collect()
    check_warc(rows, {i: (t or "").encode() for i, t in enumerate(texts)})
    assert {r.page_id: r.payload for r in rows}[9] == b"y" * 3_000_000
    raw = [h for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").collect() for h, _ in records(bytes(r.content))]
    assert Counter(h["warc-type"] for h in raw)["continuation"] >= 4 + 2
    assert round_trip(df.limit(0)).count() == 0
    odd = round_trip(spark.createDataFrame([(None, None, "z" * 200), (None, None, "z" * 200), (3, "u", "z" * 200), (3, "u", "z" * 200)], "page_id long, url string, html string"))
    assert Counter((r.page_id, r.record_type) for r in odd.collect()) == {(None, "response"): 2, (3, "response"): 2}


def test_warc_faults(spark, tmp_path):
    assert unframed(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc" and unframed(framed(b"")) == b""
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            unframed(bad)
    df = spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string")
    write_warc(df, f"{tmp_path}/w", segment=500)
    heads = [h for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").collect() for h, _ in records(bytes(r.content))]
    assert all({"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length"} <= set(h) for h in heads) and len({h["warc-record-id"] for h in heads}) == len(heads)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").collect())
    assert read_warc(spark, f"{tmp_path}/w").first().payload == b"abc" * 1000
    (tmp_path / "cut").mkdir()
    kept = data.split(b"WARC/1.1\r\n")
    (tmp_path / "cut" / "a.warc").write_bytes(b"WARC/1.1\r\n".join(kept[:2] + kept[3:]))
    with pytest.raises(Exception, match="segments"):
        read_warc(spark, f"{tmp_path}/cut").collect()
    both = spark.createDataFrame([(i, "u", "abc" * 1000) for i in range(3)], "page_id long, url string, html string")
    write_warc(both, f"{tmp_path}/v", segment=500)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(f"{tmp_path}/v").collect())
    heads = [h for h, _ in records(data)]
    own = {h["warc-record-id"]: h["x-page-id"] for h in heads if h["warc-type"] == "response"}
    assert [own[h["warc-refers-to"]] for h in heads if h["warc-type"] == "revisit"] == ["0", "0"]
    kept = data.split(b"WARC/1.1\r\n")
    for name, parts in (("gone", [kept[0]] + [x for x in kept[1:] if x.startswith(b"WARC-Type: revisit")]), ("other", [x.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0") if x.startswith(b"WARC-Type: revisit") else x for x in kept])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"WARC/1.1\r\n".join(parts))
        with pytest.raises(Exception, match="no record with this payload"):
            read_warc(spark, f"{tmp_path}/{name}").collect()
