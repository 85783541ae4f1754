"""Operators against brute-force versions on odd documents, and defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headline_engine.llm import common, decontaminate, fingerprint, langid, linechunks, ngramjoin, packing, substrings, tokenfile, tokens, warc

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def alnum(text):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def key(i):
    return -(1 << 63) if i is None else i


# 1 ------------------------------------------------------------------------------------------------


def brute_decontamination(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[a : a + window])].add(item)
    out = []
    for i, text in rows:
        w, hit, found = alnum(text), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                got = wins.get(tuple(w[a : a + n]))
                if got:
                    hit |= set(range(a, a + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), bool(hit)))
    return out


def test_decontamination(spark, odd, odd_rows, none):
    long = next(t for _, t in odd_rows if t and len(t) > 60000).split()
    items = [(1, " ".join(long[500:540])), (2, "One two, THREE"), (3, None), (4, ""), (5, "w1"), (6, " ".join(long[505:520])), (7, "nowhere to be found"),
             (8, "w1"), (8, "w1"), (30, "漢字 かな"), (9, "ÉTÉ"), (10, odd_rows[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, win int")
    got = decontaminate.report(odd, df)
    want = brute_decontamination(odd_rows, items)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert decontaminate.report(none, df).count() == 0
    assert decontaminate.report(odd, df.limit(0)).where("contaminated or n_items > 0").count() == 0
    kept = decontaminate.decontaminate(odd, df)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in want if not r[5])
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct", plan)


def test_decontamination_of_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, f"before {passage} after")] * 3 + [(None, f"{passage} twice"), (None, f"{passage} twice"), (2, passage), (3, "p0 p1 p2 and more"), (3, "p0 p1 p2 and more")]
    items = [(1, passage), (2, "p0 p0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontamination(rows, items)
    assert sum(r[5] for r in want) == 6
    assert Counter(map(tuple, decontaminate.report(docs, df).collect())) == Counter(want)
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, df).collect()] == [3, 3]


def test_proximity_matches_words_that_moved(spark):
    docs = spark.createDataFrame([(1, "zz alpha x beta gamma delta"), (2, "alpha beta gamma delta"), (3, "delta q q q q q q gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    _, exact, _ = decontaminate.find(docs, items)
    assert {r["_id"] for r in exact.collect()} == {2}
    _, near, _ = decontaminate.find(docs, items, slack=1)
    assert {r["_id"] for r in near.collect()} == {1, 2}


# 2 ------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, odd_rows, none):
    got = fingerprint.compare_neighbours(odd, shard_rows=1).collect()
    order = sorted(odd_rows, key=lambda r: (key(r[0]), r[1] or ""))
    order = sorted(order, key=lambda r: (key(r[0]), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    edits = [fingerprint.edited(t, texts[(j + 1) % len(texts)]) for j, t in enumerate(texts)]
    want = Counter((i, len(t), sha(e)) for (i, _), t, e in zip(order, texts, edits))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in odd.transform(fingerprint.fingerprints).collect()}
    assert all(r["fingerprint"] for r in got if r["n_chars"] > 20 and r["doc_id"] and prints[r["doc_id"]])
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1

    def grams(t):
        w = alnum(t)
        return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4) if w else 0)}

    by_sha = {sha(e): (t, e) for t, e in zip(texts, edits)}
    for r in got:
        t, e = by_sha[r["edited_sha256"]]
        a, b = grams(t), grams(e)
        if min(len(a), len(b)) > 2000:
            assert abs(r["near_edited"] - len(a & b) / min(len(a), len(b))) < 0.1
    assert fingerprint.compare_neighbours(none).count() == 0
    one = fingerprint.compare_neighbours(odd.where("doc_id = 1").limit(1)).first()
    assert one["near_next"] == 1.0  # its own successor


def test_sketches_merge():
    a, b = "a b c d e f g h i j k l m n".split(), "k l m n o p q r s t u v w x y z".split()
    buf = [" ".join(a).encode(), " ".join(b).encode()]
    off = np.cumsum([0] + [len(x) for x in buf])
    for scale in (1, 2, 8, 1000):
        x, y = fingerprint.sketches(np.frombuffer(b"".join(buf), np.uint8), off, scale)
        both = np.union1d(*fingerprint.sketches(np.frombuffer(b"".join(buf), np.uint8), off, 1))
        want = both[: max(1, int(np.searchsorted(both, np.uint64((1 << 48) // scale))))]
        assert fingerprint.merge(x, y, scale).tolist() == want.tolist()


# 4, 7 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_ids_equal_whole_text_ids(name, odd_rows):
    path = tokens.tokenizer_path(name)
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    extra = ["a  b", " \n x", "don't 'll 12 3", "\x1c a\x85b", "<|endoftext|> a", "a\n", "\na", "É. È, ß", "ab.\nCd ", "K ſ İ Σς", " é ́"]
    for _ in range(2):
        for t in [t for _, t in odd_rows if t] + extra:
            assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing(spark, odd, odd_rows, none):
    tok = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(odd, shard_rows=40).collect()
    whole = Counter()
    for i, t in odd_rows:
        whole[(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, texts in {i: [k[1] for k in whole.elements() if k[0] == i] for i, _ in whole}.items():
        got = sorted((r["doc_tokens"], r["start"], bytes(r["ids"])) for r in pieces[i])
        assert sum(len(x) // 4 for _, _, x in got) == sum(len(t) // 4 for t in texts)
        for r in pieces[i]:
            assert any(t[4 * r["start"] : 4 * (r["start"] + r["length"])] == bytes(r["ids"]) and len(t) // 4 == r["doc_tokens"] for t in texts)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 2048
        sizes.append(at)
    shards = len({q >> 32 for q in seqs})
    assert sum(x < 2048 for x in sizes) <= shards  # only a shard's last window is padded
    assert packing.pack(none).count() == 0


def test_packing_takes_lexical_neighbours():
    rnd = np.random.default_rng(1)
    topics = [rnd.integers(1000 * k, 1000 * k + 60, (8, 100)) for k in range(4)]
    docs = [topics[i % 4][i // 4] for i in range(32)]
    pieces = packing.pack_shard(docs, window=800)
    of = defaultdict(set)
    for d, _, _, s, _ in pieces:
        of[s].add(d % 4)
    assert all(len(v) == 1 for v in of.values())


@pytest.mark.parametrize("topics", [40, 80])
def test_packing_shards_related_documents_together(spark, topics):
    """Documents of one topic meet in a shard, in a small table as in a larger one."""
    rnd = np.random.default_rng(2)
    common_words = [f"word{i}" for i in range(50)]
    rows = []
    for k in range(topics):
        own = ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(12)]
        rows += [(8 * k + j, " ".join(rnd.permutation([*rnd.choice(own, 30), *rnd.choice(common_words, 60)]))) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shard = {r["doc_id"]: r["sequence_id"] >> 32 for r in packing.pack(df, shard_rows=40).collect()}
    assert max(Counter(shard.values()).values()) <= 40
    together = [shard[8 * k + i] == shard[8 * k + j] for k in range(topics) for i in range(8) for j in range(i)]
    assert np.mean(together) > 0.2  # dealt at random: 0.125 and 0.0625


def test_token_files(spark, odd, odd_rows, none):
    tok = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    folder = common.shared_dir(spark, "t")
    tokenfile.write(odd, folder, shard_rows=1, roll_ids=3000)
    got = tokenfile.read(spark, folder).orderBy("start").collect()
    at, want = 0, []
    for i, t in sorted(odd_rows, key=lambda r: (key(r[0]), r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    folder = common.shared_dir(spark, "t")
    tokenfile.write(none, folder)
    assert tokenfile.read(spark, folder).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(0)), max_size=200), st.integers(1, 15))
def test_simple8b_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    words, index, esc, val = tokenfile.encode(v)
    assert tokenfile.decode(words, len(v), esc, val).tolist() == v.tolist()
    for b in range(len(index) - 1):  # blocks by themselves
        lo, hi = b * tokenfile.BLOCK, min(len(v), (b + 1) * tokenfile.BLOCK)
        x, y = np.searchsorted(esc, [lo, hi])
        part = tokenfile.decode(words[int(index[b]) : int(index[b + 1])], hi - lo, esc[x:y] - np.uint64(lo), val[x:y])
        assert part.tolist() == v[lo:hi].tolist()


# 5 ------------------------------------------------------------------------------------------------


def test_warc(spark, odd_rows):
    pages = [(i, f"http://a/{i}\n", t) for i, t in odd_rows] + [(1000 + i, None, "x" * 100) for i in range(5)] + [(1100 + i, None, "x" * 99) for i in range(3)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int").repartition(3)
    digests = []
    for _ in range(2):
        folder = common.shared_dir(spark, "w")
        manifest = warc.write(df, folder, roll_bytes=2000, shard_rows=1)
        digests.append(sorted((r["file"], r["sha256"]) for r in manifest.collect()))
        df = df.repartition(7)
    assert digests[0] == digests[1] and len(digests[0]) > 5  # the same bytes from other partitions
    got = warc.read(spark, folder).collect()
    first = {}
    for i, _, t in sorted(pages, key=lambda p: key(p[0])):
        first.setdefault(t or "", i)
    want = Counter()
    for i, _, t in pages:
        b = (t or "").encode()
        revisit = len(b) >= 100 and first[t] != i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[t] if revisit else None, None if revisit else t or "")] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got) == want
    folder = common.shared_dir(spark, "w")
    warc.write(df.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs)
    got = got.withColumn("held", langid.held_out(got["doc_id"]))
    rows = got.where("held and length(text) > 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(odd).collect()}
    assert out[(None, None)]["lang_pred"] == "und" and out[(None, None)]["score"] == 0
    assert all(r["lang_pred"] == ("en" if re.search(r"[^\W\d_]", t or "") else "und") for (_, t), r in out.items())
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}


def test_code_lengths_are_ppm():
    """The table's code length equals a walk down the context tree."""
    texts = {"a": "abracadabra abra cadabra", "b": "the cat sat on the mat"}
    counts = {}
    for lang, t in texts.items():
        s = "   " + t
        counts[lang] = Counter(int.from_bytes(s[i : i + 4].encode(), "big") for i in range(len(t)))
    grams = np.array(sorted(set().union(*counts.values())), np.int64)
    m = langid.Model(["a", "b"], grams, [np.array([counts[x][g] for g in grams], float) for x in "ab"])
    probe = "abra the zebra"
    got = m.code_lengths(np.frombuffer(probe.encode(), np.uint8), np.array([0, len(probe)]), m.node_maps())[0]

    def bits(lang, ctx, sym):
        total = 0.0
        for k in (3, 2, 1, 0):
            c = Counter()
            for g, n in counts[lang].items():
                b = g.to_bytes(4, "big")
                if b[3 - k : 3] == ctx[3 - k :]:
                    c[b[3]] += n
            n, d = sum(c.values()), len(c)
            if c[sym]:
                return total + np.log2((n + d) / c[sym])
            if n:
                total += np.log2((n + d) / d)
        return total + 8

    padded = ("   " + probe).encode()
    for li, lang in enumerate("ab"):
        want = sum(bits(lang, padded[i : i + 3], padded[i + 3]) for i in range(len(probe)))
        assert abs(got[li] / 1024 - want) < 0.05


# 8 ------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=50):
    least = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            least[k] = min(least.get(k, key(i)), key(i))
    out = []
    for i, t in rows:
        w, gone = SPACE.findall(t or ""), set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < key(i):
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def test_substring_dedup(odd, odd_rows, none):
    got = substrings.digest(substrings.remove_repeats(odd)).collect()
    want = brute_repeats(odd_rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert Counter(map(tuple, got)) == Counter(want)
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("window,k", [(8, 3), (12, 5), (20, 10)])
def test_substring_dedup_of_overlapping_repeats(spark, window, k):
    import random

    rnd = random.Random(window)
    rows = [(rnd.randrange(12), " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for _ in range(40)]
    rows += [(i, "a " * rnd.randrange(40)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.digest(substrings.remove_repeats(df, window, k)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows, window))


# 9 ------------------------------------------------------------------------------------------------


def brute_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, a = [], 0
    for i in range(len(lines)):
        cut = i >= linechunks.SPAN - 1 and sum(h[i - j] * linechunks.ROLL**j for j in range(linechunks.SPAN)) % linechunks.DIVISOR == 0
        if cut or i == len(lines) - 1:
            out.append((a, i + 1 - a, "\n".join(lines[a : i + 1])))
            a = i + 1
    return out


def test_line_dedup(spark, none):
    import random

    rnd = random.Random(3)
    block = [f"{i * i} shared line of a block" for i in range(14)]
    rows = []
    for i in range(40):
        lines = [f"own {i} {j}" for j in range(rnd.randrange(12))]
        if i % 3:
            lines[len(lines) // 2 : len(lines) // 2] = block[: rnd.randrange(5, 15)]
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n\n\n"), (53, "\n\n\n\n"), rows[4], rows[4], (7, "\n".join(block)), (None, "\n".join(block)), (54, "\n".join(f"l{i}" for i in range(5000)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string").repartition(4)
    th = {(r["doc_id"], r["text"]): r["t"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) t").collect()}
    first = {}
    for i, t in sorted(set(rows), key=lambda r: (key(r[0]), th[r])):
        for a, n, c in brute_chunks(t) if t is not None else []:
            if n >= 2:
                first.setdefault(c, (key(i), th[(i, t)], a))
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, 0, 0, sha("")))
            continue
        ch = brute_chunks(t)
        keep = [c for a, n, c in ch if n < 2 or first[c] == (key(i), th[(i, t)], a)]
        want.append((i, t.count("\n") + 1, sum(n for _, n, _ in ch) - sum(c.count("\n") + 1 for c in keep), sha("\n".join(keep))))
    got = linechunks.report(df)
    assert sum(r[2] > 0 for r in want) > 10
    assert Counter(map(tuple, got.collect())) == Counter(want)
    kept = linechunks.clean(df)
    assert kept.columns == ["doc_id", "text", "lines", "n_lines", "n_removed"]
    assert kept.where("text is null").count() == 1
    assert linechunks.report(none).count() == 0
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct", got._jdf.queryExecution().toString())


# 10 -----------------------------------------------------------------------------------------------


def brute_groups(rows, t=0.8):
    texts = {}
    for n, (i, text) in enumerate(rows):
        texts.setdefault(tuple(alnum(text)), []).append(n)
    keys = list(texts)
    sets = [{k[a : a + 5] for a in range(max(1, len(k) - 4))} if k else set() for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 64)
    for a, k in enumerate(keys):
        low[find(a)] = min([low[find(a)], *(key(rows[n][0]) for n in texts[k])])
    unkey = lambda x: None if x == key(None) else x
    out = []
    for a, k in enumerate(keys):
        for n in texts[k]:
            out.append((rows[n][0], unkey(low[find(a)]), links[a], unkey(min(key(rows[m][0]) for m in texts[k])), len(texts[k])))
    return out


def test_ngram_join(odd, odd_rows, none):
    got = ngramjoin.report(odd).collect()
    want = brute_groups(odd_rows)
    assert max(r[2] for r in want) > 10
    assert Counter(map(tuple, got)) == Counter(want)
    kept = ngramjoin.keep_first(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[1] for r in want}
    assert ngramjoin.report(none).count() == 0


def test_keep_first_keeps_one_of_equal_rows(spark):
    rows = [(1, "one text that is there twice")] * 2 + [(None, "a text without an id")] * 2 + [(2, "one text that is there twice"), (3, None), (4, "alone")]
    kept = ngramjoin.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter({rows[0]: 1, rows[2]: 1, rows[5]: 1, rows[6]: 1})


def test_ngram_join_in_small_blocks(spark, monkeypatch):
    """A hot group over many block pairs gives the same links."""
    import random

    rnd = random.Random(5)
    base = [f"v{rnd.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(120)] = f"e{i}{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngramjoin.report(df).collect())) == Counter(brute_groups(rows))


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngramjoin.least_matches()
    assert len(least) == ngramjoin.HASHES // ngramjoin.STEP and least == sorted(least)
    from math import comb

    for k, need in enumerate(least):
        n = (k + 1) * ngramjoin.STEP
        assert sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need)) < 1e-6  # a pair at 0.8 is dropped so rarely
        assert need > 0 or n == ngramjoin.STEP


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in ngramjoin.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# helpers ------------------------------------------------------------------------------------------


def test_contiguous_shards(spark):
    import random

    rnd = random.Random(2)
    ids = [rnd.randrange(-5, 10**6) for _ in range(2000)] + [1 << 61, -(1 << 63)] + [77] * 300
    df = spark.createDataFrame([(i,) for i in ids], "x long")
    s = common.contiguous_shards(df, "x", 50, cells=16)
    got = defaultdict(list)
    for r in df.select("x", s.column.alias("s")).collect():
        got[r["s"]].append(r["x"])
    order = sorted(got)
    assert all(max(got[a]) < min(got[b]) for a, b in zip(order, order[1:]))
    assert all(len(v) <= 50 or len(set(v)) == 1 or len([x for x in v if x != 77]) <= 50 for v in got.values())
    assert set(order) <= set(range(s.n))


# 3 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(odd, odd_rows, none, order):
    from headline_engine.llm import lmscore

    docs = [alnum(t) for _, t in odd_rows]
    total = Counter(tuple(w[a : a + n]) for w in docs for n in range(1, order + 1) for a in range(len(w) - n + 1))
    words = sum(map(len, docs))
    want = []
    for (i, _), w in zip(odd_rows, docs):
        own = Counter(tuple(w[a : a + n]) for n in range(1, order + 1) for a in range(len(w) - n + 1))
        c = lambda g: total[g] - own[g]  # noqa: B023, E731
        s = 0.0
        for j in range(len(w)):
            for n in range(min(order, j + 1), 1, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if c(g) > 0:
                    s += np.log10(c(g) / c(g[:-1]))
                    break
                s += np.log10(0.4)
            else:
                g = (w[j],)
                s += np.log10(c(g) / (words - len(w))) if c(g) > 0 else np.log10(1 / (words - len(w) + 1))
        want.append((i, len(w), round(float(s), 4)))
    got = lmscore.score(odd, order=order, chunk_rows=10).collect()
    assert Counter((r["doc_id"], r["n_words"], round(r["log10_score"], 4) + 0.0) for r in got) == Counter((i, n, s + 0.0) for i, n, s in want)
    assert lmscore.score(none, order=order).count() == 0
