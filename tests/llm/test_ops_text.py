"""SimHash, PII, decontamination, suffix and passage dedup, and the pipeline, against brute force."""

import collections
import datetime
import hashlib
import random

import numpy as np
import pytest
import xxhash

from talus.llm import decontamination, neardup, passages, pii, simhash, suffix
from talus.llm.common import components, shipped, stored

WORDS = "alpha beta gamma delta dé x omega the of and sun moon river stone tree bird".split()


def text_of(rd, n):
    return " ".join(rd.choice(WORDS) for _ in range(n))


@pytest.fixture(autouse=True)
def ship(spark):
    shipped(spark)


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(t, k=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rd = random.Random(1)
    for t in [None, "", " \t", "One", "A b C", "ÉTÉ été", *(text_of(rd, rd.randint(1, 40)) for _ in range(30))]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("bucket_rows", [20000, 7])
def test_simhash_links(spark, bucket_rows):
    rd = random.Random(2)
    base = [rd.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << rd.randrange(64) for _ in range(rd.randint(0, 5))) & (1 << 64) - 1 for b in base for _ in range(25)} | {0, (1 << 64) - 1, 1})
    df = stored(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"))
    edges = [(r.u, r.v) for r in simhash.linked(df, 4, bucket_rows).collect()]
    place = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert roots(len(fps), [(place[u], place[v]) for u, v in edges]) == want


@pytest.mark.parametrize("budget", [0, 3, 6])
def test_trie_walk_finds_every_pair_once(budget):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64) << np.uint64(30))
    got = [(a, b) for x, y in simhash.trie_links(fps, np.array([0, len(fps)]), budget, leaf=8, room=64) for a, b in zip(x.tolist(), y.tolist())]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_components(spark):
    rd = random.Random(4)
    base = [text_of(rd, 60) for _ in range(5)]
    docs = [(i, " ".join(w if rd.random() > 0.01 else "edit" for w in rd.choice(base).split())) for i in range(60)] + [(90, None), (91, ""), (None, base[0]), (2, base[1]), (2, base[1])]
    rows = simhash.grouped(stored(simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")))).collect()
    fps = [slow_fingerprint(t) for _, t in docs]
    root = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {r: min(d for (d, _), q in zip(docs, root) if q == r and d is not None) for r in set(root)}
    assert collections.Counter((r.doc_id, r.fp, r.component_id) for r in rows) == collections.Counter((d, int(np.uint64(f).view(np.int64)), least[q]) for (d, _), f, q in zip(docs, fps, root))
    assert simhash.grouped(stored(simhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102, 200)}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def feistel(left, right, a, b, tweak, key):
    for i in range(1, pii.ROUNDS + 1):
        other = right if i % 2 else left
        f = int(hashlib.sha256("|".join([key, tweak, str(i), str(other)]).encode()).hexdigest()[:15], 16)
        left, right = ((left + f) % a, right) if i % 2 else (left, (right + f) % b)
    return left, right


def slow_digits(d, kind, key):
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), f"{kind}{len(d)}", key)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def slow_day(day, key):
    since = datetime.date(1900, 1, 1) if day < datetime.date(2000, 1, 1) else datetime.date(2000, 1, 1)
    a, b = (92, 397) if since.year == 1900 else (75, 487)
    left, right = feistel(*divmod((day - since).days, b), a, b, str(since), key)
    return since + datetime.timedelta(left * b + right)


def test_pseudonyms(spark):
    rd = random.Random(5)
    cards = []
    while len(cards) < 20:
        d = "".join(rd.choice("0123456789") for _ in range(rd.choice([13, 15, 16, 19])))
        if luhn(d):
            cards.append(d)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rd.randrange(73049)) for _ in range(20)]
    phones = [f"+1 ({rd.randrange(1000):03d}) 555-{rd.randrange(10000):04d}" for _ in range(10)]
    texts = [f"{c}$$ {c[:4]}-{c[4:]} {d} and {d:%m/%d/%Y} {d:%d.%m.%Y}, {p}." for c, d, p in zip(cards, days, phones * 2)]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for c, d, p, t in zip(cards, days, phones * 2, got):
        body = slow_digits(c[:-1], "card", "k")
        new = next(body + x for x in "0123456789" if luhn(body + x))
        day = slow_day(d, "k")
        national = slow_digits("".join(filter(str.isdigit, p))[1:], "phone", "k")
        assert t == f"{new}$$ {new[:4]}-{new[4:]} {day} and {day:%m/%d/%Y} {day:%d.%m.%Y}, +1 ({national[:3]}) {national[3:6]}-{national[6:]}."


def test_pseudonyms_leave_the_rest_alone(spark):
    keep = ["1234567812345678", "999.1.1.1", "1.2.3.4.5", "000-12-3456", "2023-02-30", "token = \"4785380592391139aa\"", "v4785380592391139", "12345", "a@b", "", None, "1899-12-31 2100-01-01"]
    rows = [(i, t, "x") for i, t in enumerate(keep)] + [(50, "write été.5@ex.co now", "x"), (51, "write été.5@ex.co now", "x"), (52, "at 10.20.30.40, ssn 123-45-6789", "x")]
    out = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string, _other string"), "k").collect()}
    assert [out[i].text for i in range(len(keep))] == keep and all(out[i].n_replaced == 0 for i in range(len(keep)))
    assert out[50].text == out[51].text != rows[-3][1] and out[50].text.endswith("@example.invalid now") and out[50]._other == "x"
    assert out[52].n_replaced == 2 and "10.20.30.40" not in out[52].text and "123-45-6789" not in out[52].text


def test_pseudonyms_beside_other_text(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    alone = ["10.1.2.3", "2024-01-15", card, spaced, "555-123-4567", "5500000000000004"]
    forms = ["http://{0}/", "see http://{0}/1", "{1}T10:00:00Z", "{1}Z", "{2} 123", "12 {3}", "12 35 {3} 99 8", "{2} {4}", "{3} {5}", "{3}x 5", "a {2}, {0}, {1}."]
    rows = list(enumerate(alone + [f.format(*alone) for f in forms]))
    out = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = [out[i].text for i in range(len(alone))]
    assert all(a != b for a, b in zip(alone, new))
    for i, f in enumerate(forms, len(alone)):
        if f != "{3}x 5":
            assert (out[i].text, out[i].n_replaced) == (f.format(*new), f.count("{"))
        else:
            assert out[i].n_replaced == 0


def test_pseudonyms_edge_cases(spark):
    long = "word " * 300_000 + "4111111111111111"
    rows = [(1, long, "a", 7), (2, None, None, None), (3, "", "b", 1), (3, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hits string, _new int")
    out = pii.pseudonymised(docs, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n_replaced"] and out.count() == 4
    assert got[1].n_replaced == 1 and got[1].text.startswith(long[:-16]) and got[1].text != long and (got[1]._hits, got[1]._new) == ("a", 7)
    assert got[2].text is None and got[3].text == "" and pii.pseudonymised(docs.filter("false"), "k").count() == 0


def test_pseudonyms_in_long_runs(spark):
    """Runs that a recursive or backward-going match would not survive, each with a value at its end."""
    card = "4111111111111111"
    runs = [
        "12 " * 200_000 + "x " + card,
        "123 " * 200_000 + card,
        "1-" * 200_000 + "x, " + card,
        "1-1 1-" * 100_000 + "1x " + card,
        "." * 1_000_000 + " " + card,
        "-" * 1_000_000 + " " + card,
        "7" * 10_000_000 + " x " + card,
        "a@b" + ".c" * 500_000 + " " + card,
        "a." * 500_000 + " " + card,
        "1." * 500_000 + " " + card,
        "1/" * 500_000 + " " + card,
        "x@" * 500_000 + " " + card,
        "555-" * 200_000 + "x " + card,
    ]
    whole = ["a@b" + ".c" * 500_000 + ".com", "a@b" + ".cd" * 300_000 + ".c9-"]
    rows = list(enumerate([card, *runs, *whole]))
    out = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "k").collect()}
    for i, t in enumerate(runs, 1):
        assert out[i].text == t.removesuffix(card) + out[0].text and out[i].n_replaced == 1, t[:20]
    assert [out[i].text[17:] for i in (len(runs) + 1, len(runs) + 2)] == ["@example.invalid", "@example.invalid.c9-"]


def test_many_cards_in_a_run(spark):
    cards = ["4111111111111111", "5500000000000004"] * 1000
    out = pii.pseudonymised(spark.createDataFrame([(0, " ".join(cards)), (1, " ".join(cards[:2]))], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert out[0].text == " ".join([out[1].text] * 1000) and out[0].n_replaced == 2000


def test_simhash_edge_cases(spark):
    long = "many words of a very long text " * 60_000
    docs = spark.createDataFrame([(1, long, 1, "a", 5), (2, long, 1, "a", 5), (3, None, None, None, None)], "doc_id long, text string, fp int, component_id string, root int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.grouped(stored(simhash.fingerprints(docs))).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[3] == (0, 3)


def test_pseudonyms_do_not_collide(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "concat('10.0.', id div 256, '.', id % 256) as text")
    assert pii.pseudonymised(df, "k").select("text").distinct().count() == 20000


def slow_tiles(item, doc, tile):
    """Greedy string tiling by looking at every pair of starts."""
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_a and b + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < tile:
            return total
        used_a |= set(range(a, a + n))
        used_b |= set(range(b, b + n))
        total += n


def test_tiles_against_brute_force(spark):
    rd = random.Random(6)
    items = [(i, text_of(rd, rd.randint(3, 25))) for i in range(8)] + [(8, None), (9, "")]
    docs = []
    for i in range(40):
        parts = [text_of(rd, 6)]
        for _ in range(rd.randint(0, 2)):
            w = items[rd.randrange(8)][1].split()
            cut = rd.randint(0, len(w))
            parts += [" ".join(w[cut:]), "and, then;", " ".join(w[:cut]).upper()]
        docs.append((i, " ".join(parts)))
    docs += [(50, None), (51, ""), (3, docs[3][1])]
    want = collections.Counter()
    for d, t in docs:
        for i, x in items:
            a, b = (x or "").split(), (t or "").lower().replace(",", "").replace(";", "").split()
            if len(a) >= 5 and slow_tiles(a, b, 5) / len(a) >= 0.8:
                want[d, i] += 1
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontamination.BLOCK, 60):
        assert collections.Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, size=size).collect()) == want
        assert {r.doc_id for r in decontamination.cleaned(df, bench, size=size).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.cleaned(df.limit(0), bench).count() == 0


def test_reordered_passage_is_found(spark):
    a = " ".join(f"w{i}" for i in range(30)).split()
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(a[15:] + ["mid"] + a[:15])), (2, " ".join(a[:15]))], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [1]


def slow_removed(docs, n):
    first = {}
    for d, t in docs:
        b, k = (t or "").encode(), suffix.NO_ID if d is None else d
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], k), k)
    out = collections.Counter()
    for d, t in docs:
        b, k = (t or "").encode(), suffix.NO_ID if d is None else d
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < k:
                gone[i : i + n] = [True] * n
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


def overlapping(seed):
    rd = random.Random(seed)
    base = [text_of(rd, 40) for _ in range(4)]
    docs = []
    for i in range(50):
        parts = [text_of(rd, rd.randint(0, 5))]
        for _ in range(rd.randint(0, 3)):
            b = rd.choice(base)
            a = rd.randint(0, len(b) - 1)
            parts.append(b[a : a + rd.randint(10, 150)])
        docs.append((i, " # ".join(parts)))
    docs += [(None, base[0]), (None, base[0]), (61, None), (62, ""), (3, docs[5][1]), (63, docs[5][1]), (63, docs[5][1]), (70, "ab" * 200), (71, "ab" * 60), (72, "\0" * 120), (73, "\0" * 70)]
    rd.shuffle(docs)
    return docs


@pytest.mark.parametrize("task_bytes, family", [(24 << 20, 50_000), (800, 50_000), (800, 1), (800, 5)])
def test_suffix_dedup(spark, task_bytes, family):
    docs = overlapping(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.deduplicated(df, task_bytes=task_bytes, family=family).collect())
    assert got == slow_removed(docs, 50)


def test_suffix_dedup_of_texts_with_equal_short_digests(spark):
    """126 common bytes, between texts whose 64-bit digests begin (or end) with equal 32 bits."""
    body = "the river runs past the old stone mill and on to the sea, where boats of every size lie at anchor in the last light of the day. "[:126]
    docs = [(1, body + "tail 81284"), (2, body + "tail 102920"), (3, "something else " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.deduplicated(df).collect()) == slow_removed(docs, 50)


def test_suffix_dedup_edge_cases(spark):
    long = "".join(random.Random(15).choice("abcd ") for _ in range(4 << 20))
    docs = [(1, long, "a", 1), (2, "x" + long[1000:2000], "b", 2), (None, None, None, None), (3, "", "c", 3)]
    out = {r.doc_id: r for r in suffix.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, chunk string, kind int").repartition(2)).collect()}
    assert out[1].n_removed == 0 and (out[2].n_removed, out[2].n_spans, bytes(out[2].kept)) == (1000, 1, b"x") and out[None].n_bytes == out[3].n_bytes == 0


def test_suffix_dedup_without_repeats(spark):
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(40))) for i in range(4)] + [(9, None)]
    got = suffix.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert all(r.n_removed == r.n_spans == 0 and bytes(r.kept).decode() == (dict(docs)[r.doc_id] or "") for r in got)


def test_suffix_dedup_of_nothing(spark):
    assert suffix.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_prefixes():
    rd = random.Random(8)
    for _ in range(60):
        segments = list({bytes(rd.choice(b"abc") for _ in range(rd.randint(5, 14))) for _ in range(rd.randint(1, 12))})
        ids = np.array([rd.randint(0, 9) for _ in segments])
        for s, got in zip(segments, suffix.least_ids(segments, ids, 5)):
            assert got.tolist() == [min(int(i) for q, i in zip(segments, ids) if s[a : a + 5] in q) for a in range(len(s) - 4)]


@pytest.mark.parametrize("key_rows", [2000, 3])
def test_passages(spark, key_rows):
    rd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rd.choice(vocabulary) for _ in range(n)]
    passage, near = some(60), some(120)
    docs = []
    for i in range(30):
        body = some(rd.randint(0, 200))
        at = rd.randint(0, len(body))
        if i % 3 == 0:
            body[at:at] = passage
        docs.append((i, " ".join(body)))
    docs += [(40 + k, " ".join(w if rd.random() > 0.01 else "edit" for w in near)) for k in range(6)]
    docs += [(60, None), (61, ""), (62, "few words"), (63, " ".join(["same"] * 80))]
    out = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), key_rows=key_rows).collect()
    assert {r.doc_id for r in out} == {i for i in range(30) if i % 3 == 0} | set(range(40, 46))
    heads = {(r.cluster_doc, r.cluster_word) for r in out}
    assert heads == {(r.doc_id, r.start_word) for r in out if r.kept}
    assert all(r.n_words == 25 and r.start_word + 25 <= len(dict(docs)[r.doc_id].split()) for r in out)
    assert passages.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_units(text, words=25):
    """(start, size) of paragraphs, and of the ends of long ones; anchored passages are left to the caller."""
    at, out = 0, set()
    for line in (text or "").split("\n"):
        n = len(line.split())
        if 5 <= n < words:
            out.add((at, n))
        elif n >= words:
            out |= {(at, words), (at + n - words, words)}
        at += n
    return out


def test_passage_links_and_clusters(spark):
    """Units, exact similarities and clusters against all pairs, and paragraphs whole."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    shared_lines = ["short line that two documents have here", "\n".join(["edge one two three", "a longer paragraph " + " ".join(f"v{i}" for i in range(70))])]
    docs += [(900 + i, f"own{i} " * 30 + "\n" + x + "\n" + f"end{i} " * 9) for i, x in enumerate(shared_lines * 2)] + [(None, docs[0][1]), (None, docs[0][1])]
    units = {}
    own = passages.Passages([(t or "").encode() for _, t in docs])
    for o, a, n in zip(own.owner.tolist(), own.start.tolist(), own.size.tolist()):
        units[o, a, n] = frozenset(zip(*(docs[o][1].lower().split()[a + k : a + n - 4 + k] for k in range(5))))
        assert n <= 25 and units[o, a, n]
    assert all({(a, n) for o, a, n in units if o == i} >= slow_units(t) for i, (_, t) in enumerate(docs))
    where = list(units)
    sets = [units[w] for w in where]
    by = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            by[g].append(i)
    common = collections.Counter((i, j) for own in by.values() for j in own for i in own if i < j)
    pairs = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    root = roots(len(where), pairs)
    several = collections.defaultdict(set)
    for w, q in zip(where, root):
        several[q].add(w[0])
    want = {w for w, q in zip(where, root) if len(several[q]) > 1}
    rows = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    number = {d: i for i, (d, _) in enumerate(docs) if d is not None}
    got = {(number[r.doc_id], r.start_word, r.n_words) for r in rows if r.doc_id is not None}
    told = {w for w in want if docs[w[0]][0] is not None}
    assert got <= told and len(got) >= 0.97 * len(told)
    cluster = {(number[r.doc_id], r.start_word, r.n_words): (r.cluster_doc, r.cluster_word) for r in rows if r.doc_id is not None}
    links = [(where[i], where[j]) for i, j in pairs if where[i] in cluster and where[j] in cluster and (number[docs[where[i][0]][0]] % 5 == 0)]
    assert len(links) > 20 and sum(cluster[a] == cluster[b] for a, b in links) >= 0.9 * len(links)
    assert sum(r.doc_id is None for r in rows) > 0 and sum(r.kept for r in rows) == len({(r.cluster_doc, r.cluster_word, r.n_words) for r in rows if r.kept})
    longer = sorted((r.start_word, r.n_words) for r in rows if r.doc_id == 901)
    covered = {k for a, n in longer for k in range(a, a + n)}
    assert len(covered & set(range(34, 107))) >= 70  # the paragraph of 73 words, but for single words between units
    assert any(r.doc_id == 900 and r.n_words == 7 for r in rows)


def test_passages_edge_cases(spark):
    word = random.Random(16)
    long = " ".join(f"w{word.randrange(5000)}" for _ in range(700_000))
    schema = "doc_id long, text string, chunk int, hash string, Name string"
    docs = [(1, long, 1, "a", "n"), (2, " ".join(long.split()[50_000:50_060]), 2, "b", "n"), (3, None, None, None, None), (4, "", 1, "c", "n")]
    out = passages.repeated(spark.createDataFrame(docs, schema).repartition(2)).collect()
    assert {r.doc_id for r in out} == {1, 2} and all(r.cluster_doc == 1 for r in out)
    text = " ".join(f"u{i}" for i in range(30))
    assert passages.repeated(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")).count() >= 4


@pytest.mark.parametrize("rounds", [2, 0])
def test_one_of_each_group(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    rd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(2000)]
    docs = []
    for g in range(8):
        base = [rd.choice(vocabulary) for _ in range(150)]
        for k in range(rd.randint(1, 6)):
            w = list(base)
            if k > 1:
                w[rd.randrange(150)] = "edit"
            docs.append((g * 10 + k, " ".join(w), g))
    docs += [(900, None, 9), (901, "", 9), (902, "", 9), (3, docs[0][1], 0), (None, docs[0][1], 0)]
    kept = neardup.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, component_id int")).collect()
    if rounds:
        assert sorted((r.component_id, r.doc_id) for r in kept) == sorted((g, min(d for d, _, x in docs if x == g and d is not None)) for g in {x for _, _, x in docs})
    else:
        assert sorted(r.component_id for r in kept) == sorted({x for _, _, x in docs})


@pytest.mark.parametrize("rounds, part", [(1, 256), (2, 256), (2, 8)])
def test_one_of_each_chain(spark, monkeypatch, rounds, part):
    """Chains of edits that keep the words, so all are candidates: groups are those of all pairs."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "PART", part)
    rd, texts = random.Random(12), []
    for _ in range(3):
        words = [f"w{i}" for i in range(120)]
        rd.shuffle(words)
        for _ in range(30):
            for _ in range(rd.choice([0, 1, 1, 2, 5])):
                i, j = rd.randrange(120), rd.randrange(120)
                words[i], words[j] = words[j], words[i]
            texts.append(" ".join(words))
    rd.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(roots(len(texts), pairs)) and len(pairs) > 40


@pytest.mark.parametrize("few", [16, 1])
def test_one_of_each_beyond_the_bits(spark, monkeypatch, few):
    """Links whose fingerprints differ in more bits than the budget; short texts, so an edit moves many."""
    monkeypatch.setattr(neardup, "FEW", few)
    rd, texts = random.Random(13), []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(60)]
        texts += [" ".join(words), " ".join(words[rd.randint(1, 11) :]), " ".join(words + [f"g{g}x{i}" for i in range(rd.randint(1, 13))])]
    texts += texts[:20]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [neardup.described(t)[1] for t in texts]
    assert sum((int(prints[i]) ^ int(prints[j])).bit_count() > neardup.BUDGET for i, j in pairs) > 20
    kept = neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(roots(len(texts), pairs))


def test_one_of_each_recall(spark):
    """Documents with ids divisible by 5 against all: of a pair at 0.8 or more never both stay, unless a link keeps one for another."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in neardup.one_of_each(docs).collect()}
    sets = {d: set(neardup.shingles(t).tolist()) for d, t in texts.items()}
    near = {}
    for q in sets:
        if q % 5 == 0:
            near[q] = [d for d in sets if d != q and len(sets[q] & sets[d]) >= 0.8 * len(sets[q] | sets[d])]
    found = [(q, d) for q, own in near.items() for d in own]
    assert len(found) > 5 and sum(not (q in kept and d in kept) for q, d in found) / len(found) >= 0.9
    assert all(q in kept for q, own in near.items() if not own)  # what has no near duplicate stays


def test_near_dedup_edge_cases(spark):
    schema = "doc_id long, text string, rid long, Same string, fp int, _rid int"
    assert neardup.one_of_each(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000
    rows = [(1, long, 1, "a", 1, 1), (2, long + "x", 1, "a", 1, 1), (None, None, None, None, None, None), (3, "", 1, "a", 1, 1), (3, "", 1, "a", 1, 1), (4, "own words here", 2, "b", 2, 2)]
    kept = neardup.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "rid", "Same", "fp", "_rid"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]


def test_decontamination_edge_cases(spark):
    schema = "doc_id long, text string, item_id string, coverage int, Tiles string"
    item = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, "x " * 500_000 + "one two three four five six seven", "a", 1, "t"), (None, "one two three four five six seven", "a", 1, "t"), (2, None, "a", 1, "t"), (3, "", None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id or 0, r.item_id, r.coverage) for r in decontamination.contaminated(docs, item).collect()) == [(0, 1, 1.0), (1, 1, 1.0)]
    kept = decontamination.cleaned(docs, item)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
    assert decontamination.cleaned(docs.filter("false"), item).count() == 0 and decontamination.cleaned(docs, item.filter("false")).count() == 5


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    rd = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    body = lambda n: " ".join(rd.choice(vocabulary) for _ in range(n))
    item = body(20)
    texts = {1: body(80), 2: "123 456 !!", 4: f"{body(30)} {item} {body(30)}", 5: f"{body(60)} 4111111111111111 {body(5)}", 6: None, 7: body(90)}
    texts[3] = texts[1]
    folder = f"{corpus_pipeline.stored.__globals__['shared_dir'](spark)}/pipeline-test"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        seen.append({r.doc_id for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen == [{1, 3, 4, 5, 7}, {1, 4, 5, 7}, {1, 5, 7}, {1, 5, 7}]
    out = {r.doc_id: r for r in docs.collect()}
    assert "4111111111111111" not in out[5].text and out[1].text == texts[1] and out[5].n_chars == len(out[5].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {1, 5, 7}
