"""The operators on documents against brute force and the tokenizers library, on a test table and on awkward rows."""

import hashlib
import json
import textwrap
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pathweave.llm import bpe, licenses, mixing, ngram_join, quality, queries, substring, token_files, toxicity
from pathweave.llm.shared import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.BYTE_BPE)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_jaccard_groups(spark, docs):
    got = Counter(map(tuple, queries.QUERIES["op1_ngram_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute.groups(docs)


def test_jaccard_awkward(spark):
    df = brute.awkward(spark, 3000)
    got = Counter(map(tuple, ngram_join.similar_groups(df).collect()))
    known = brute.groups([x for x in rows_of(df) if x[0] is not None])
    missing = Counter((None, len(brute.shingles(t)), None) for i, t in rows_of(df) if i is None)
    assert got == known + missing
    assert ngram_join.similar_groups(brute.none(spark)).count() == 0


def test_jaccard_frequent_shingles(spark):
    """A group larger than any list that is paired inside a task, with members that only some others are similar to."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(60, i % 9, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:20] + [f"o{i}x{k}" for k in range(40)])) for i in range(60)]  # a passage in many
    rows += [(300 + i, " ".join(f"t{(i + k) % 7}" for k in range(6 + i % 4))) for i in range(40)]  # light sets
    got = Counter(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute.groups(rows)


def test_jaccard_template_with_own_words(spark):
    """Many documents of one list that no link can join, among some that are linked across sizes."""
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common[:19] + [f"o{i}x{k}" for k in range(5)])) for i in range(400)]
    for i in range(400, 520):
        rows.append((i, " ".join(common[: rng.integers(60, 120)] + [f"o{i}x{k}" for k in range(rng.integers(0, 25))])))
    got = Counter(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute.groups(rows)


def test_size_bands(spark):
    got = [r.band for r in spark.range(1, 200_000).select(ngram_join.size_band(queries.F.col("id")).alias("band")).collect()]
    assert got == sorted(got) and got[:70] == [*range(1, 65), *got[64:70]]
    assert max(got[4 * n // 3 - 1] - got[n - 1] for n in range(100, 140_000, 997)) <= 20


def test_subsets_decide_alone():
    for n in range(1, 9):
        for m in ngram_join.partner_sizes(n, 3, 4):
            need = ngram_join.overlap(n, m, 3, 4)
            assert 100 * need >= 75 * (n + m - need) and (need == 0 or 100 * (need - 1) < 75 * (n + m - need + 1))
    assert 0 < ngram_join.choose_boundary({n: 100 for n in range(1, 33)}, 3, 4) < 17


def test_substring(spark, docs):
    got = queries.QUERIES["op4_substring_dedup"](spark, SF).collect()
    want = {(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute.kept(docs)}
    assert {tuple(r) for r in got} == want


def test_substring_awkward(spark):
    df = brute.awkward(spark, 3000)
    out = substring.remove_repeats(df)
    assert set(df.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    got = Counter(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept").collect()))
    assert got == Counter(brute.kept(rows_of(df)))
    assert substring.remove_repeats(brute.none(spark)).count() == 0


def test_automaton_shards(spark):
    """Texts cut into overlapping shards give the same removals, also where a passage repeats in the shards of its owner."""
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words)
    assert [(k, x.split()[0], len(x.split())) for k, x in substring.shards_of(text, 50, 70)] == [(k, f"w{21 * k}", min(70, 300 - 21 * k)) for k in range(12)]
    passage = [f"p{i}" for i in range(55)]
    rows = [
        (1, text), (2, " ".join(["x"] + words[40:180] + ["y"] + words[200:249])), (3, " ".join(words[10:60])),
        (5, " ".join([*passage, *(f"a{i}" for i in range(90)), *passage])), (4, " ".join(["b"] * 30 + passage)), (6, " ".join(passage[3:] + ["c"] * 60)),
        (7, text), (8, "short one"), (8, text + " more"), (9, "short one"), (9, " ".join(words[5:90])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, 70, 1000):
        for parts in (1, 5):
            got = substring.remove_repeats(df.repartition(parts), shard_words=size).select("doc_id", "n_words", "n_removed", "kept")
            assert Counter(map(tuple, got.collect())) == Counter(brute.kept(rows))


def test_substring_hot_passage(spark, monkeypatch):
    """Of a passage in a third of all documents a task sends its smallest owner on, not each of its places."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(20)] + (passage if i % 3 == 0 else []) + [f"v{i}x{k}" for k in range(40)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = []
    original = substring.IdFilter

    def seen(ids, column):
        if "places" in ids.columns:
            places.append(ids.agg({"places": "max"}).first()[0])
        return original(ids, column)

    monkeypatch.setattr(substring, "IdFilter", seen)
    got = substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert 1 < places[0] <= 4
    assert Counter(map(tuple, got)) == Counter(brute.kept(rows))


def test_bpe_and_token_files(spark, docs, library):
    coded = {r.doc_id: r for r in queries.QUERIES["op8_bpe_transducer"](spark, SF).collect()}
    filed = {r.doc_id: r for r in queries.QUERIES["op10_token_files"](spark, SF).collect()}
    start = 0
    for i, text in sorted(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = coded[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        r = filed[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += len(ids) + 1


def test_bpe_awkward(spark, library):
    df = brute.awkward(spark, 20_000)
    key = lambda i, t: (-1 if i is None else i, t or "")
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows_of(df))
    encoded = bpe.encode(df, queries.BYTE_BPE)
    assert Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == want
    to = new_path(spark, "tokens")
    token_files.write_tokens(df, to, queries.BYTE_BPE)
    got = sorted(token_files.read_tokens(spark, to).collect(), key=lambda r: r.start)
    texts = sorted(rows_of(df), key=lambda x: key(*x))
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    assert [np.frombuffer(bytes(r.ids), "<u2").tolist() for r in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts]
    empty = new_path(spark, "tokens")
    token_files.write_tokens(brute.none(spark), empty, queries.BYTE_BPE)
    assert token_files.read_tokens(spark, empty).count() == 0 == bpe.round_trip(brute.none(spark), queries.BYTE_BPE).count()


def test_bpe_leading_space(spark, library):
    """Texts that begin with one space: their first unit is empty."""
    texts = [" hello", " ", " hello world", " a ", " .", " 1 b.", " é x", "b ", "", " hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = sorted(bpe.encode(df, queries.BYTE_BPE).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got] == want
    to = new_path(spark, "tokens")
    token_files.write_tokens(df, to, queries.BYTE_BPE)
    got = sorted(token_files.read_tokens(spark, to).collect(), key=lambda r: r.start)
    assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in got] == [(i, [*ids, 0]) for i, ids in enumerate(want)]


def test_units_read_piece_by_piece(library):
    """Whatever words are made of, and also when units are forgotten and met again."""
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        encode = token_files._encoder("small generations", f.read())
    rng = np.random.default_rng(2)
    characters = list("abcXYZ019.,!?'_-~{}[]()@#/\\\n\n\t\r\x1c\x7f") + ["\u00e9", "\u65e5", "\u00a0", " ", " ", " "]
    texts = ["".join(rng.choice(characters, rng.integers(0, 40))) for _ in range(3000)]
    texts += [" a1b2 ~~x_y{z}[q] don't it's \n\nfoo\nBar.\nbaz! \n x", " 12,345.67\n8%", " tail ", "\n", " \n", "x\r\ny", " a\n b", "a <|endoftext|> b\nc"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [x.tolist() for x in encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    units = token_files.RecentUnits(lambda new: [x.encode() for x in new], 5)
    for _ in range(3):
        for k in range(40):
            words = [f"w{k}", "often", f"w{k % 7}", f"w{39 - k}"]
            assert units([" ".join(["x", *words])]) == [("x" + "".join(" " + w for w in words)).encode()]


def test_pieces_are_read_once(library, monkeypatch):
    """A word is read by the model once, whatever its letters and whatever follows it."""
    asked = []

    class Counted(token_files.RecentUnits):
        def __init__(self, encode_all, size):
            super().__init__(lambda new: asked.extend(new) or encode_all(new), size)

    monkeypatch.setattr(token_files, "RecentUnits", Counted)
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        encode = token_files._encoder("counted", f.read())
    words, ends = ["the", "\u00e9t\u00e9", "Stra\u00dfe", "ci\u00f3n"], ["", ".", ",", "***", "!!", "&&&", ".%%%", ",###"]
    texts = [" ".join(["x", *[w + e for w in words]]) for e in ends] + ["x " + ".\n".join(words)] * 2
    for part in (texts[:3], texts[3:], texts):
        assert [x.tolist() for x in encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    asked = [x for x in asked if x]
    # words after a space, words after a line's end, what follows words and the line's end
    assert len(asked) == len(set(asked)) <= len(words) + len(words) - 1 + len(ends)


def test_units_cut_by_arrow(library):
    """White space, letters at the borders of the plain ones, special tokens, nulls and slices, as the library reads them."""
    twice = [chr(c) * 2 for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = token_files._flags(pc.match_substring_regex(pa.array(twice), token_files._SPACES))
    assert [x for x, y in zip(twice, found, strict=True) if y] == [x for x in twice if x.isspace()]
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        data = f.read()
    encode = token_files._encoder("cut by arrow", data)
    texts = [f"x a{chr(c)}b1{chr(c)} {chr(c)} {chr(c)}{chr(c)}.\n{chr(c)}9" for c in [*range(0x260), 0x3B1, 0x430, 0x65E5, 0x1F642]]
    texts += [None, "", " ", "a  b", " <|endoftext|> a", "\tx \t1\ty", "x a\n", "x \na", "x a\n\nb", "x y" * 3000]
    want = [e.ids for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode(texts)] == want
    array = pa.array(texts)
    assert [x.tolist() for lo in range(0, len(texts), 7) for x in encode(array.slice(lo, 7))] == want
    assert [encode([x])[0].tolist() for x in texts[-10:]] == want[-10:]
    # a normalizer before the pattern: nothing goes past it
    lower = json.dumps(json.loads(data) | {"normalizer": {"type": "Lowercase"}})
    got = token_files._encoder("lower-cased", lower)(texts)
    assert [x.tolist() for x in got] == [e.ids for e in type(library).from_str(lower).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_slices(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 4)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 10)
    sizes = [0, 3, 30, None, 0, 1, 1, 1, 1, 4, 4, 4, 10, 11, 0]
    batch = pa.record_batch({"id": list(range(len(sizes))), "text": [None if n is None else "x" * n for n in sizes]})
    parts = [[sizes[i] or 0 for i in x.column(0).to_pylist()] for x in token_files._slices(batch)]
    assert [n for x in parts for n in x] == [n or 0 for n in sizes]
    assert all(len(x) <= 4 and (sum(x) <= 10 or len(x) == 1) for x in parts)


def test_transducer_is_stable(library):
    """Chunks of any size give the library's ids, also within one very long pretoken."""
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    lookahead = vocabulary.sufficient_lookahead()
    rng = np.random.default_rng(3)
    pieces = ["a", " ", "  ", "\n", "'", "s", "re", "!", "<|endoftext|>", "<|end", "é", "日", "1", "\x1c", "\x85", "ing", "\t", "🙂", "́", "'ll", "²", "　", "-"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 70))) for _ in range(400)]
    texts += ["a" * 3000, "".join(rng.choice(list("abcdefgh"), 5000)), " " * 3000 + "x", "!?" * 2000, "é" * 1500, "!" * 900 + "'s" + "!" * 90, ("in" * 30 + "!" * 99) * 20]
    decoder = bpe.Decoder(vocabulary)
    for chunk in (40, 300, 1 << 16):
        machine = bpe.Transducer(vocabulary, lookahead, chunk)
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(machine.encode(text), "<u4").tolist() == ids, (chunk, text[:80])
            assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for _ in range(60):
        v = np.sort(rng.integers(0, rng.choice([1, 5, 1000, 10**9, 2**50]), rng.integers(0, 300)))
        e, _ = token_files.EliasFano.read(token_files.EliasFano.of(v).to_bytes(), 0)
        assert e.all().tolist() == v.tolist() == [e[i] for i in range(len(v))]
    with pytest.raises(IndexError):
        token_files.EliasFano.of(np.array([1]))[1]


def test_quality(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality_rules"](spark, SF).collect()}
    for i, text in docs:
        r, want = got[i], brute.statistics(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)


def test_quality_is_native_and_learns(spark):
    df = brute.awkward(spark, 3000)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    out = quality.judge(df, labels)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()) == Counter((i, *brute.statistics(t)) for i, t in rows_of(df))
    assert quality.judge(brute.none(spark), labels).count() == 0
    plan = quality.statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rng = np.random.default_rng(1)
    x = {"words": rng.uniform(50, 900, 900), "symbols": np.where(np.arange(900) % 5 == 0, rng.uniform(0.2, 0.5, 900), rng.uniform(0, 0.02, 900))}
    rules = quality.learn(x, np.arange(900) % 5 == 0)
    assert len(rules) == 1 and [t[:2] for t in rules[0].tests] == [("symbols", True)] and 0.02 < rules[0].tests[0][2] < 0.25
    assert quality.learn(x, np.zeros(900, bool)) == []


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op6_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.7 and np.mean([r.predicted for r in clean]) < 0.02


def test_toxicity_awkward(spark):
    model = toxicity.train(["you idiot person here", "what an idiot that is", "a fine day out", "the nice long road"] * 5, np.array([1, 1, 0, 0] * 5))
    s = model.scores(["some idiot said", "some idiots said", "the day was fine", "", "İ" * 3])
    assert s[0] > s[2] and s[1] > s[2] and (0 <= s).all() and (s <= 1).all()
    out = toxicity.score(brute.awkward(spark), model)
    assert out.count() == 21 and out.where("score is null or predicted is null").count() == 0 and len(set(out.columns)) == len(out.columns)
    assert toxicity.score(brute.none(spark), model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(brute.awkward(spark), no_labels, queries.F.lit(True))
    assert 0 <= model.scores(["x"])[0] < 0.7


def test_toxicity_texts_do_not_touch():
    """A text's score does not depend on the texts read with it; nor do the words that training reads."""
    model = toxicity.train(["you idiot person here", "what an idiot that is", "a fine day out", "the nice long road"] * 5, np.array([1, 1, 0, 0] * 5))
    x, y = "some idiot said idiot", "a fine idiot"
    alone = {t: model.scores([t])[0] for t in (x, y, "")}
    for texts in ([x, x], [y, x], [x, "", x], ["", y, y, x], [x, x, x, y]):
        assert np.allclose(model.scores(texts), [alone[t] for t in texts], rtol=1e-9, atol=0)
    assert toxicity.words_of([x, y, x]).fresh.tolist() == [True, True, True, False, True, True, True, True, True, True, False]
    assert toxicity.joined_words([x, x]).fresh.tolist() == [True, True, True, False] * 2


def test_toxicity_long_texts_in_pieces():
    """A text scores the same in one piece and in many, also with words longer than a piece and repeated words at the cuts."""
    model = toxicity.train(["you idiot person here", "what an idiot that is", "a fine day out", "the nice long road"] * 5, np.array([1, 1, 0, 0] * 5))
    rng = np.random.default_rng(3)
    pool = ["idiot", "you", "fine", "day", "long", "road", "person", "x" * 90, "\u0130diot", "\u00c9t\u00e9", "..", "what,is"]
    gaps = [" ", "\n", ".  ", "\u3000"]
    texts = ["".join(str(w) + str(g) for w, g in zip(rng.choice(pool, n), rng.choice(gaps, n), strict=True)) for n in (1, 30, 33, 64, 65, 100, 700, 2000)]
    texts += ["y" * 5000, "idiot " * 500, " " * 3000, "a fine day " * 300 + "you idiot person " + "nice road " * 300]
    whole = np.concatenate([model.logits([x], 1 << 30) for x in texts])
    for piece in (40, 150, 1000):
        np.testing.assert_allclose(model.logits(texts, piece), whole, atol=1e-9)


def test_licenses_wrapped_over_lines(spark):
    model = licenses.train(["the road to the town", "rights and wrongs of it", "he was reading"] * 20)
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 70))
    for mark in ("", "# ", " * "):
        rows = [(i, f"some words before\nof the town\n{mark}\n{wrap(t, mark)}\n\nthe road to it\nhe was reading", f) for i, (f, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
        out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"), model)
        got = {r.doc_id: r.families for r in out.collect()}
        assert [i for i, _, f in rows if f not in got[i]] == []
    parted = licenses.TEMPLATES["BSD"][2].replace("binary forms,", "binary forms,\n\n \n")  # blank lines part paragraphs
    assert licenses.scan(spark.createDataFrame([(1, parted)], "doc_id long, text string"), model).first().families == []


def test_licenses_match_the_plain_model(spark, docs):
    model = licenses.train(["the road to the town", "rights and wrongs of it", "he was reading"] * 20)
    df = spark.createDataFrame([*docs[:40], (900, None), (901, ""), (902, "x\nReleased under the MIT License.\nAll rights reserved."),
        (903, "a\n\n \nThis work is licensed\nunder the GNU General\nPublic License, version 3.\n"), (904, "\nreleased under\nthe\nMIT License\n\t\nlicense"), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")

    def is_(paragraph):
        w = licenses.words(paragraph)
        p = model.probabilities(w)
        family = licenses.FAMILIES[int(p.argmax())]
        if w and family != licenses.UNKNOWN:
            return family, round(p.max(), 6), round(licenses.template_share(w, family), 6)

    for r in licenses.scan(df, model).join(df, "doc_id").collect():
        want = []
        lines = (r.text or "").split("\n")
        for k, line in enumerate(lines):
            if is_(line):
                lo = hi = k
                while lo > max(k - 3, 0) and lines[lo - 1].strip(" \t\x0b\f\r"):
                    lo -= 1
                while hi < min(k + 3, len(lines) - 1) and lines[hi + 1].strip(" \t\x0b\f\r"):
                    hi += 1
                block = is_(" ".join(lines[lo : hi + 1]))
                want.append((k, *(block if is_(line)[2] < 0.6 and block and block[2] >= 0.6 else is_(line))))
        assert [(x.paragraph, x.family, round(x.probability, 6), round(x.template_share, 6)) for x in r.found] == want
        if r.doc_id == 902:
            assert r.families == ["All-rights-reserved", "MIT"] and r.n_paragraphs == 3
    assert licenses.scan(brute.awkward(spark, 2000), model).count() == 21 and licenses.scan(brute.none(spark), model).count() == 0
    assert licenses.train([]).features


def mix_by_hand(rows, entropy, repeats, ratio, seed="mix"):
    """Copies of each row (id, source, tokens), as mixing.copies deals them."""
    md5 = lambda *x: hashlib.md5(":".join([seed, *map(str, x)]).encode()).hexdigest()
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())

    def weights(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def largest(meets):
        if meets(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if meets(mid) else (lo, mid)
        return lo

    flat = largest(lambda a: -sum(w * np.log(w) for w in weights(a).values()) >= entropy * np.log(len(tokens)))
    limit = largest(lambda a: max(w * ratio * total / tokens[s] for s, w in weights(a).items()) > repeats)
    quota = {s: int(w * ratio * total) for s, w in weights(max(flat, limit)).items()}
    out = {}
    for s in {s for _, s, _ in rows}:
        own = [(i, n) for i, t, n in rows if t == s]
        passes, rest = divmod(quota.get(s, 0), tokens.get(s, 1))
        blocks = {}
        for i, n in own:
            blocks.setdefault(md5(i)[:3], []).append((i, n))
        before = 0
        for b in sorted(blocks, key=lambda b: md5("block", s, b)):
            size = sum(n for _, n in blocks[b])
            used = 0
            for i, n in sorted(blocks[b], key=lambda x: md5("place", x[0])):
                used += n
                fits = before + size <= rest or (before < rest and used <= rest - before)
                out[i] = 1 if n == 0 else passes + fits
            before += size
    return out


@pytest.mark.parametrize(("entropy", "repeats", "ratio"), [(0.95, 4.0, 1.0), (1.0, 9.0, 0.5), (0.99, 1.2, 2.0)])
def test_mixing(spark, entropy, repeats, ratio):
    rows = [(i, f"s{0 if i % 3 else i % 7}", (i * 37) % 90) for i in range(700)]
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, s, n in rows], "doc_id long, source string, text string")
    got = {r.doc_id: r.copies for r in mixing.copies(df, entropy=entropy, repeats=repeats, budget_ratio=ratio).collect()}
    assert got == mix_by_hand(rows, entropy, repeats, ratio)


def test_mixing_keeps_all_without_a_budget(spark):
    df = brute.awkward(spark, 3000)
    out = mixing.mixed(df, budget_ratio=None, repeats=2.0)
    assert out.columns == df.columns
    before, after = Counter(rows_of(df)), Counter(rows_of(out))
    assert set(before) == set(after) and all(before[x] <= n <= 2 * before[x] for x, n in after.items())
    assert mixing.schedule(brute.none(spark)).count() == 0 == mixing.mixed(brute.none(spark)).count()
    got = mixing.schedule(df)
    assert got.groupBy("doc_id", "epoch").count().where("doc_id is not null and doc_id not in (13, 14) and count > 1").count() == 0
