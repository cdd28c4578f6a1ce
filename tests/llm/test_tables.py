"""Pages, vectors, the pipeline and the registry."""

import gzip
import hashlib
import math
from collections import Counter

import brute
import compare
import pyarrow as pa
import pytest

import corpus_pipeline
from pathweave.llm import mixing, queries, shared, topk, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = compare.duck(SF)
    df = queries.QUERIES[name](spark, SF)
    assert compare.type_mismatches(df, con, queries.ORACLES[name]) == {}
    assert compare.spark_rows(df) == compare.duck_rows(con, queries.ORACLES[name])


def test_warc_awkward(spark):
    long, short = "ä" * 70_000, "s" * 40
    rows = [(5, "http://x/5", long), (3, None, long), (9, "u", short), (2, "u v\r\nWARC-Type: x", short), (7, "", None), (8, "u", ""), (None, "n", long), (4, "u", "x" * 100), (4, "u", "x" * 100), (6, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, record int, digest string")
    to = shared.new_path(spark, "warc")
    warc.write_archives(pages, to)
    got = Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.with_sizes(warc.read_archives(spark, to)).collect())
    first = {long: 3, "x" * 100: 4}
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        to_id = first.get(html) if i is not None and first.get(html) != i else None
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "response" if to_id is None else "revisit", to_id)] += 1
    assert got == want
    parts = {}
    for r in warc.payloads(spark, to).collect():
        parts.setdefault(r.record, {})[r.chunk] = bytes(r.payload)
    assert len(parts) == len(rows) and max(len(x) for x in parts.values()) > 1
    assert Counter(b"".join(v for _, v in sorted(x.items())) for x in parts.values())[long.encode()] == 2  # the response and the row without an id
    empty = shared.new_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_notices_damage():
    reader = warc.Reader()
    data = warc._headers(1, "u", hashlib.sha256(b"abc").hexdigest(), None, 3) + b"abd\r\n\r\n"
    with pytest.raises(ValueError, match="chunk digest"):
        reader.feed(gzip.compress(data), warc.zlib.crc32(b"abc"), True)


def chunks_of(*payloads):
    """Chunk rows (record, chunk, last, crc32, data) as the writer makes them."""
    rows = [(2 * i, i, "http://x/%d" % i, p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=list("abcdef"))
    found = pa.Table.from_batches(list(warc._writer(1)(iter([batch])))).to_pylist()
    return [tuple(r[c] for c in ("record", "chunk", "last", "crc32", "data")) for r in found]


def read_chunks(rows):
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds)], names=list("abcde")) for r in sorted(rows, key=lambda r: r[:2])]
    return [r["id"] for b in warc._read(iter(batches)) for r in b.to_pylist()]


def test_warc_chunks_missing_doubled_or_cut():
    rows = chunks_of(b"a" * 80_000, b"b" * 70_000, b"c")
    assert read_chunks(rows) == [0, 1, 2] and [len([r for r in rows if r[0] == n]) for n in (0, 2, 4)] == [3, 3, 1]
    for k, row in enumerate(rows):  # any chunk of a record of several gone: first, middle, last
        if row[0] < 4:
            with pytest.raises(ValueError, match=f"record {row[0]} "):
                read_chunks(rows[:k] + rows[k + 1 :])
        with pytest.raises(ValueError, match=f"record {row[0]} "):
            read_chunks([*rows, row])
        with pytest.raises(ValueError, match=f"record {row[0]}"):
            read_chunks([*rows[:k], (*row[:4], row[4][: len(row[4]) - 9]), *rows[k + 1 :]])
        with pytest.raises(ValueError, match=f"record {row[0]}"):
            read_chunks([*rows[:k], (*row[:3], row[3] ^ 1, row[4]), *rows[k + 1 :]])
    with pytest.raises(ValueError, match="record 0 lacks chunk 2"):
        read_chunks(rows[:2])
    with pytest.raises(ValueError, match="record 0 lacks chunk 0"):
        read_chunks(rows[2:3])


def test_warc_archive_is_a_gzip_member_a_record(spark):
    """The bytes of an archive, member by member, are whole WARC records."""
    texts = {1: "ä" * 60_000, 2: "x" * 200, 3: None, 4: "x" * 200}
    pages = spark.createDataFrame([(i, f"http://p/{i}", t) for i, t in texts.items()], "page_id long, url string, html string")
    to = shared.new_path(spark, "warc")
    warc.write_archives(pages, to, archives=1)
    data = b"".join(bytes(r.data) for r in spark.read.parquet(to).orderBy("record", "chunk").collect())
    records = {}
    while data:
        unpacker = warc.zlib.decompressobj(31)
        record = unpacker.decompress(data)
        assert unpacker.eof
        data = unpacker.unused_data
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        records[fields["WARC-Target-URI"]] = (fields["WARC-Type"], rest[:-4])
    assert records == {f"http://p/{i}": ("revisit", b"") if i == 4 else ("response", (t or "").encode()) for i, t in texts.items()}


def test_top_k_awkward(spark):
    rows = [(i, [math.sin(i * k) for k in range(1, 9)]) for i in range(300)]
    rows += [(300, rows[10][1]), (301, rows[10][1]), (302, None), (303, [None] + [0.5] * 7), (304, [math.nan] * 8), (305, [math.inf] * 8), (306, [0.1, 0.2]), (None, rows[3][1]), (308, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 306")).collect()))
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 50 == 0 or q == 306:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 == topk.top_k(df, df.limit(0)).count()


def test_top_k_minus_one_and_large(spark):
    """An id of -1 is an id like any other; large components are scored exactly and spoil no other row."""
    rows = [(i, [math.sin(i * k) for k in range(1, 5)]) for i in range(-3, 200)]
    rows += [(500, [-3.0e9, 3.0e9, 1.0, 0.0]), (501, [-3.0e9, 3.0e9, 1.0 + 1 / 256, 0.0]), (502, [1e300, 0.0, 0.0, 0.0]), (503, [-1.7e308] * 4), (504, [0.0, 0.0, 0.0, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = lambda v: [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v]
    asked = [(-1, rows[2][1]), (0, [0.0, 0.0, 1.0, 0.0]), (7, [-1.0, 1.0, -0.5, 0.25]), (504, rows[-1][1])]
    want = []
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(ints(v), ints(w), strict=True)), i) for i, w in rows if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    fine = {q for q, _ in asked} - {q for q, _, _, s in want if abs(s) >= 2**63}
    assert len(fine) >= 2
    got = topk.top_k(df, spark.createDataFrame([x for x in asked if x[0] in fine], df.schema))
    assert sorted(map(tuple, got.collect())) == sorted(x for x in want if x[0] in fine)
    with pytest.raises(Exception, match="exceeds BIGINT"):
        topk.top_k(df, spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], df.schema)).collect()
    alone = spark.createDataFrame([(-1, [1.0]), (2, [2.0])], df.schema)
    assert sorted(map(tuple, topk.top_k(alone, alone).collect())) == [(-1, 1, 2, 131072), (2, 1, -1, 131072)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "temperature_mixing", "bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared.new_path(spark, name)
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(df.columns == columns for df in seen[:-1])
    texts = [sorted((r.doc_id, r.text) for r in df.collect()) for df in seen[:-1]]
    clean = queries.QUERIES["op6_toxicity"](spark, SF).where("predicted = 0").select("doc_id").collect()
    assert [i for i, _ in texts[1]] == sorted(r.doc_id for r in clean)
    root = {i: c for i, _, c in brute.groups(texts[1])}
    assert texts[2] == [(i, t) for i, t in texts[1] if root[i] == i]
    assert texts[3] == sorted((i, k if r else t) for (i, _, r, k), (_, t) in zip(brute.kept(texts[2]), texts[2], strict=True))
    times = {r.doc_id: r.copies for r in mixing.copies(seen[3], entropy=0.95, repeats=2.0, budget_ratio=None).collect()}
    assert Counter(texts[4]) == Counter({x: times[x[0]] for x in texts[3]}) and min(times.values()) >= 1
    last = seen[-1].collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in texts[4])
    by_id = dict(texts[4])
    assert all(r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest() for r in last)
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in last)
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_repeated_ids(spark):
    """Of rows that repeat an id and a text one stays; rows without an id and other texts of an id stay."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "b"), (1, base, "a"), (1, base, None), (2, base, "a"), (3, "one", "a"), (3, "two", "a"), (4, None, "a"), (4, None, "a"), (5, "five", "a"), (None, base, "a"), (None, base, "a"), (6, "", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert got == Counter([(1, base, None), (3, "one", "a"), (3, "two", "a"), (4, None, "a"), (5, "five", "a"), (None, base, "a"), (None, base, "a"), (6, "", None)])


def test_registry():
    import __spark_entry__ as e

    found = e.queries()
    assert all(sum(x.startswith(f"op{n}_") for x in found) == 1 for n in range(1, 11)) and "pipeline" in found
    assert set(e.oracle_sql()) <= set(found)
