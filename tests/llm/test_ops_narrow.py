"""Packing, sharding, WARC, language and quality against brute force and exact round trips."""

import collections
import io
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import langid, packing, quality, sharding, warc
from talus.llm.common import numbered, shared_dir, shipped, stored, table

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "One two three.", "One two three.", "x" * 30000, "word " * 9000, "ÉTÉ d'été, naïve 3½!", "a\x1cb c\x85d", "<|endoftext|> it's"]


@pytest.fixture(scope="module")
def docs(spark):
    shipped(spark)
    rows = [(i if i != 3 else None, t, "en", i) for i, t in enumerate(TEXTS)] + [(4, "One two three.", "en", 99)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, shard int").repartition(3)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZéÉ'sñß1٣½ \t\n\x1c\x85  İΣς.,!|#$<>_-中é́ll’re​🙂"), max_size=60), max_size=6))
def test_cached_ids_are_those_of_the_whole_text(texts):
    tokenizer = packing.CachedTokenizer(vocabulary(), limit=20)
    assert [np.frombuffer(b, "<u4").tolist() for b in tokenizer(texts)] == plain_ids(texts)


def test_pieces_hold_all_ids(spark, docs):
    rows = packing.packed(docs).collect()
    want = collections.Counter()
    for d, t in docs.select("doc_id", "text").collect():
        ids = plain_ids([t])[0] + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[d, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 4096)


def check_places(places, capacity):
    by = collections.defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used = collections.Counter()
    for n, held in packing.plan(counts, 64):
        assert n > 0 and sum(length * times for length, times in held) <= 64
        for length, times in held:
            used[length] += n * times
    assert used == collections.Counter(counts)


def test_plan_finds_exact_complements():
    made = packing.plan({40: 3, 24: 3, 30: 2, 20: 2, 14: 2, 16: 4, 31: 1, 11: 1, 12: 1, 10: 1}, 64)
    assert all(sum(a * b for a, b in held) == 64 for n, held in made)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every placing."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= lengths[i]}.values():
            free[k] -= lengths[i]
            place(i + 1, free)
            free[k] += lengths[i]
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_plan_takes_few_sequences():
    rng = np.random.default_rng(4)
    extra = 0
    for _ in range(300):
        lengths = rng.integers(1, 65, rng.integers(1, 10)).tolist()
        got = sum(n for n, _ in packing.plan(dict(collections.Counter(lengths)), 64))
        best = fewest(lengths, 64)
        assert best <= got <= best + 1 and got >= -(-sum(lengths) // 64)
        extra += got - best
    assert extra <= 30


def slow_language(labelled, text):
    """(language or None, posterior), by dictionaries of strings: words first, then ever shorter n-grams."""
    if not text or not any(c.isalpha() for c in text):
        return None, 0.0
    count = collections.defaultdict(collections.Counter)  # by length and language
    for t, lang in labelled:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            count[0, lang][w] += 1
            for n in range(1, langid.LONGEST + 1):
                count[n, lang].update(w[i : i + n] for i in range(len(w) - n + 1))
    langs = sorted({lang for _, lang in labelled})
    for lang in langs:
        count[0, lang] = collections.Counter({w: c for w, c in count[0, lang].items() if sum((count[0, lang][w],)) > 1})
    known = {n: set().union(*(count[n, lang] for lang in langs)) for n in range(langid.LONGEST + 1)}
    sums = dict.fromkeys(langs, 0.0)

    def add(n, token):
        for lang in langs:
            sums[lang] += np.log((count[n, lang][token] + 0.5) / (count[n, lang].total() + 0.5 * len(known[n]) + 1))

    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in known[0]:
            add(0, w)
            continue
        at = 0
        while at < len(w):
            n = next((n for n in range(min(langid.LONGEST, len(w) - at), 0, -1) if w[at : at + n] in known[n]), 0)
            if n:
                add(n, w[at : at + n])
            at += max(n, 1)
    best = max(langs, key=lambda x: (sums[x], -langs.index(x)))
    return best, 1 / sum(np.exp(v - sums[best]) for v in sums.values())


def test_language_scores_are_those_of_plain_dictionaries(spark):
    rows = [(1, "the cat and the dog and the bird walked", "en"), (2, "der Hund und die Katze und der Vogel gingen", "de"), (3, "le chat et le chien et l'oiseau ÉTÉ été marchaient", "fr"), (4, "xyz", "tie"), (5, None, "en"), (6, "lost", None), (7, "", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "123 _ ?!", "²", "the cat", "und die Katzen", "chienne étée", "qqq", "zzxyzyy", "a" * 3000 + " der und", "the\u0130x the_dog2cat", "été " * 500 + "the", "the cat", "Ω漢字 the"]
    texts += [" ".join(t for t in texts if t)]
    for piece in (langid.PIECE, 40):
        best, score = model.opened().score(texts, piece)
        for t, b, s in zip(texts, best.tolist(), score.tolist()):
            lang, want = slow_language([(t, x) for _, t, x in rows if t is not None and x], t)
            assert (model.langs[b] if b >= 0 else None) == lang and s == pytest.approx(want, rel=1e-5)


def test_language_repeats_ties_and_names(spark):
    text = "the cat and the dog " * 3
    shipped(spark)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "b", 2), (2, "der Hund und die Katze " * 3, "de", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, _told long")
    model = langid.fit(docs)
    assert {(r.doc_id, r.lang_pred) for r in langid.identified(docs.drop("lang_pred"), model, ["doc_id", "_told"]).collect()} == {(1, "en"), (2, "de")}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3 and langid.accepted(docs.filter("false"), model).count() == 0
    tied = langid.fit(spark.createDataFrame([(1, "aa aa", "y"), (2, "aa aa", "x")], "doc_id long, text string, lang string"))
    assert [(r.lang_pred, r.score) for r in langid.identified(docs, tied, ["doc_id"]).collect()] == [("x", 0.5)] * 3
    long = [(9, "der Hund und " * 400_000)]
    assert langid.identified(spark.createDataFrame(long, "doc_id long, text string"), model, ["doc_id"]).first().lang_pred == "de"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(none).count() == 0 and sharding.sharded(none).count() == 0


def test_numbers_have_no_gaps_whatever_the_buckets(spark):
    df = stored(spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) as g"))
    rows = numbered(df, "g", ["id"], "n", 500, rows_per_task=40).collect()
    for g in {r.g for r in rows}:
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def one_jump(key, shards):
    """Jump consistent hashing, a key at a time, on the mixed key."""
    mask = (1 << 64) - 1
    k = key & mask
    k = ((k ^ k >> 30) * 0xBF58476D1CE4E5B9) & mask
    k = ((k ^ k >> 27) * 0x94D049BB133111EB) & mask
    k ^= k >> 31
    b, j = -1, 0
    while j < shards:
        b = j
        k = (k * 2862933555777941757 + 1) & mask
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_shards(spark, docs):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    texts = collections.defaultdict(list)
    for d, t in docs.select("doc_id", "text").collect():
        texts[d].append((t or "").encode())
    for r in rows:
        key = -1 if r.doc_id is None else r.doc_id
        assert r.shard == one_jump(key, 16) and r.grown_shard == one_jump(key, 17) and r.grown_shard in (r.shard, 16)
        assert any(r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) for t in texts[r.doc_id])
    for s in {r.shard for r in rows}:
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))


def test_jump_moves_only_the_needed_share():
    keys = np.arange(40000)
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(np.unique(b[a != b])) == {16} and abs((a != b).mean() - 1 / 17) < 0.01
    assert np.bincount(a).min() > 0.9 * len(keys) / 16


def test_warc_round_trip(spark):
    shipped(spark)
    rows = [(1, "u", "x" * 1000), (2, None, "x" * 1000), (2, "u", "x" * 1000), (None, "a b\n", None), (5, "z", "é" * 600), (6, "z", "x" * 1000), (None, "q", "é" * 600), (7, "t", "tiny"), (8, "t", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.read_back(warc.packaged(pages, f"{shared_dir(spark)}/warc-test")).collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == collections.Counter(
        [("1", "revisit", "6", 1000), ("2", "revisit", "6", 1000), ("2", "revisit", "6", 1000), (None, "response", None, 0), ("5", "response", None, 1200), ("6", "response", None, 1000), (None, "revisit", "5", 1200), ("7", "response", None, 4), ("8", "response", None, 4)]
    )
    payloads = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id}
    assert payloads["5"] == ("é" * 600).encode() and payloads["6"] == b"x" * 1000
    assert warc.read_back(warc.packaged(pages.limit(0), f"{shared_dir(spark)}/warc-none")).count() == 0


def test_zip64_directory():
    """A small archive rewritten with saturated fields, as one beyond 4 GB has them."""
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("first", b"abc")
        z.writestr("second", b"defgh")
    raw = plain.getvalue()
    want = warc.members(io.BytesIO(raw), len(raw))
    end = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<HII", raw[end + 10 : end + 20])
    listing, out, at = raw[start:end], b"", 0
    while at < len(listing):
        head = bytearray(listing[at : at + 46])
        n = struct.unpack("<H", head[28:30])[0]
        packed, size = struct.unpack("<II", head[20:28])
        offset = struct.unpack("<I", head[42:46])[0]
        head[20:28] = b"\xff" * 8
        head[42:46] = b"\xff" * 4
        head[30:32] = struct.pack("<H", 28)
        out += bytes(head) + listing[at + 46 : at + 46 + n] + struct.pack("<HHQQQ", 1, 24, size, packed, offset)
        at += 46 + n
    wide_at = start + len(out)
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(out), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, wide_at, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:start] + out + wide + locator + tail
    got = warc.members(io.BytesIO(big), len(big))
    assert got == want
    file = io.BytesIO(big)
    file.seek(warc.data_start(file, got["second"]))
    assert file.read(5) == b"defgh"


def test_languages_held_out(spark):
    out = langid.query(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edge_cases(spark):
    shipped(spark)
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "x", None), (4, None, "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, None), (4, ""), (5, "123 !!"), (6, "chienne"), (7, "中文")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(ask, model, ["doc_id"]).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "fr"] and got[3][1] == 0 and got[7][0] in ("en", "fr")
    assert {r.doc_id for r in langid.accepted(ask, model).collect()} >= {1, 2, 6} and 3 not in {r.doc_id for r in langid.accepted(ask, model).collect()}
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identified(ask, none, ["doc_id"]).collect()} == {"und"}


def slow_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é|#\n\t\x0b\x1c"), max_size=80)), min_size=1, max_size=6))
def test_statistics(texts):
    got = quality.statistics(texts)
    assert [tuple(int(got[b][i]) for b in quality.BASE) for i in range(len(texts))] == [slow_statistics(t) for t in texts]


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.standard_normal(3000)) < 0.6).astype(float)
    forest = quality.boost(x[:2000], y[:2000], [-1, 0, 0])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.8
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.7)])
    assert (np.diff(forest.score(line)) <= 1e-12).all()
    assert quality.boost(x, np.ones(3000), [0, 0, 0]) is None


def test_forest_scores_as_a_walk_of_its_trees():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((800, 3)), 2)
    forest = quality.boost(x, (x[:, 0] * x[:, 1] + 0.2 * rng.random(800) > 0.4).astype(float), [0, 0, 0])

    def walk(row):
        total = forest.bias
        for at in forest.roots.tolist():
            while forest.left[at] >= 0:
                at = forest.left[at] + int(row[forest.feature[at]] > forest.cut[at])
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x) == pytest.approx([walk(r) for r in x])


def test_quality_edge_cases(spark):
    shipped(spark)
    long = "word other " * 400_000
    rows = [(1, long, "a", 1), (2, None, "b", 2), (3, "", None, None), (4, "plain words " * 8, "c", 3), (4, "plain words " * 8, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, score int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (1, 0), (2, None)], "doc_id long, quality int")
    got = quality.judged(docs, quality.fit(docs, labels))
    assert got.columns == ["doc_id", *quality.BASE, "base_failed", "kept", "score"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.base_failed) for r in rows] == [(800_000, True), (0, True), (0, True), (16, True), (16, True)] and not any(r.kept for r in rows)
    assert quality.judged(docs.filter("false"), None).count() == 0


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_pages_refer_to_the_last_of_equal_payloads(spark, broadcast_rows):
    shipped(spark)
    rows = [(i, f"u{i}", ("x" * 1000 if i % 2 else "y" * 999), "d", i) for i in range(40)] + [(None, None, "x" * 1000, "d", 0), (90, "u", None, "d", 0), (91, "u", "", "d", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, _last int")
    got = {r.page_id: r for r in warc.decided(pages, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == 43 and all(got[i].refers_to == (39 if i % 2 and i != 39 else None) for i in range(40)) and got[None].refers_to == 39
    assert got[91].bytes == got[90].bytes == 0 and got[1].payload is None and bytes(got[39].payload) == b"x" * 1000


def test_quality_without_labels(spark):
    shipped(spark)
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "few words")], "doc_id long, text string")
    forest = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(docs, forest).collect()}
    assert forest is None and got == {1: (False, True), 2: (True, False), 3: (True, False)}


def test_quality_agrees_with_labels(spark):
    rows = quality.query(spark, SF).drop("score").join(table(spark, SF, "labels"), "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.9
