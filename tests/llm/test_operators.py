"""The operators on small tables with nulls, empties, ties, repeats and odd columns, against brute force or the public libraries."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from threadloom.llm import bpe, ivfpq, jaccard_join, lang_id, lbl_lm, mixing, token_bin, token_count, vec_dedup, warc
from threadloom.llm.shards import with_shard
from threadloom.llm.shared import shared_dir
from threadloom.llm.words import words

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __size string"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "été", "straße", "x1", "!!", "<|endoftext|>", "ñu", "字"]
    rows = []
    for k in range(60):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text), "x"))
    long = " ".join(rng.choice(words) + str(k % 700) for k in range(9000))
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    rows += [(60, None, "en", None, None, None), (61, "", "en", "a", 0, "y"), (62, long, "de", "b", 1, "z"), (None, "no id here at all", None, "b", 1, "z")]
    rows += [(70 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "a", 1, "") for k in range(0, 20, 2)]
    rows += [(100, " ".join(base).upper(), "en", "a", 1, ""), (100, " ".join(base).upper(), "en", "a", 1, ""), (101, "one two", "en", "a", 1, ""), (102, "ONE  two", "de", "a", 1, "")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_token_counts(docs, spark):
    pieces = token_count.unigram_pieces(PIECES)
    low = min(s for _, s in pieces)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", low) for i in range(256))], 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for r in token_count.token_counts(docs, PIECES).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]
    assert token_count.token_counts(docs.limit(0), PIECES).count() == 0
    clash = token_count.token_counts(docs.withColumn("N_tokens", F.lit(-1)), PIECES)
    assert clash.columns == [*docs.columns, "n_tokens"] and clash.where("n_tokens < 0").count() == 0


def test_language(spark, docs):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(k, make("abcde" if k % 2 else "vwxyz"), "one" if k % 2 else "two") for k in range(80)]
    table = spark.createDataFrame([*rows, (90, None, "one"), (91, "12 !!", None), (92, "", "two")], "doc_id long, text string, lang string")
    model = lang_id.fit(table.where("doc_id < 60"))
    got = {r["doc_id"]: r for r in lang_id.predict(table, model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (90, 91, 92))
    nothing = lang_id.fit(table.limit(0))
    assert {r["lang_pred"] for r in lang_id.predict(table, nothing).collect()} == {"und"}


def test_language_kernel_by_brute_force(spark):
    """Scores of every row from a dense kernel over sets of byte n-grams, solved for the same landmarks and weights."""
    rng = random.Random(6)
    texts = [(k, " ".join("".join(rng.choice("abcdé" if k % 3 else "vwxyz") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 20))), "one" if k % 3 else "two") for k in range(60)]
    texts += [(100 + k, f"{'qrs' * k} Ünseen {k} grams!", None) for k in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)

    def grams(text):
        b = bytes(c if c >= 0x80 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in text.encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    fitted = sorted((lang, zlib.crc32(f"language sample#{i}".encode()), grams(t)) for i, t, lang in texts if lang)
    sets = [g for _, _, g in fitted]
    marks = [k for x in ("one", "two") for k in [k for k, (lang, *_) in enumerate(fitted) if lang == x][: lang_id.LANDMARKS_PER_LANGUAGE]]
    dense = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    own = [sets[k] for k in marks]
    lang = np.array([x == "two" for x, *_ in fitted], int)
    weight = 1 / np.bincount(lang)[lang]
    weight *= len(lang) / weight.sum()
    nm, mm = dense(sets, own), dense(own, own)
    y = np.where(lang[:, None] == np.arange(2), 1.0, -1.0)
    w = np.linalg.solve(nm.T @ (weight[:, None] * nm) + lang_id.RIDGE * mm + 1e-6 * np.eye(len(own)), nm.T @ (weight[:, None] * y))
    for r in lang_id.predict(docs, model).collect():
        f = dense([grams(r["text"])], own)[0] @ w
        assert math.isclose(r["score"], min(1, max(0, (f.max() + 1) / 2)), abs_tol=2e-3), r
        assert r["lang_pred"] == ("one", "two")[f.argmax()] or abs(f[0] - f[1]) < 2e-3


def test_bpe(docs):
    library = Tokenizer.from_file(BPE)
    for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), BPE).count() == 0


def test_bpe_odd_texts():
    library, (encoder, memo) = Tokenizer.from_file(BPE), bpe._encoder(BPE)
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "é", "字", "😀", "\xa0", "1", "½", "   ", "!", "Zu", "\x1c", "\x85", "aaaa", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, count = bpe.encode_texts(memo, texts, encoder.special, encoder.v.special)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert count.sum() == len(ids)


def test_long_texts_without_spaces():
    """Chinese, letters, digits and repeats without a space: equal to the libraries, and done in seconds."""
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    texts = ["".join(chr(rng.randint(0x4E00, 0x6FFF)) for _ in range(9_000)), letters, "ab" * 20_000, "a" * 20_001, f"x {letters[:3000]} y", "ß" * 5_000]
    library, (encoder, memo) = Tokenizer.from_file(BPE), bpe._encoder(BPE)
    pieces = token_count.unigram_pieces(PIECES)
    low = min(s for _, s in pieces)
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", low) for i in range(256))], 0, True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for own in (texts, *([t] for t in texts)):
        ids, _ = bpe.encode_texts(memo, own, encoder.special, encoder.v.special)
        assert ids.tolist() == [i for t in own for i in library.encode(t, add_special_tokens=False).ids]
        counts = token_count.count_texts(token_count.Counter(pieces), {}, own)
        assert counts.tolist() == [len(unigram.encode(t, add_special_tokens=False).ids) for t in own]


def _brute_components(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := _words(t)) else frozenset()) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    out = []
    for a, (i, s) in enumerate(sets):
        out.append((i, len(s), None if i is None else min(sets[b][0] for b in range(len(sets)) if top(b) == top(a) and sets[b][0] is not None)))
    return Counter(out)


def test_jaccard_join(docs, spark):
    assert Counter(map(tuple, jaccard_join.link(docs).collect())) == _brute_components(_rows())
    assert jaccard_join.link(docs.limit(0)).count() == 0


@pytest.mark.parametrize("changes", [1, 4, 9])
def test_jaccard_join_near_group(spark, changes):
    """A group larger than hubs can settle, with copies that only just link."""
    rng = random.Random(changes)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = Counter(map(tuple, jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _brute_components(rows)


def test_signatures_find_every_similar_pair():
    t, rng = jaccard_join.Threshold(80), np.random.RandomState(4)
    for n in (1, 2, 5, 9, 17, 40, 130, 700):
        for _ in range(20):
            a = rng.randint(1, 1 << 62, n).astype(np.uint64)
            keep = rng.randint(0, n // 9 + 1)
            b = np.concatenate([a[keep:], rng.randint(1, 1 << 62, rng.randint(0, n // 9 + 1)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            h, at = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
            hard, very = jaccard_join.hard_bands(h, at, t)
            sig, row, role = jaccard_join.signatures(h, at, t, hard, very)
            pick = lambda r, bit: set(sig[(row == r) & (role & bit > 0)].tolist())  # noqa: B023, E731
            assert pick(0, 1) & pick(1, 2) or pick(1, 1) & pick(0, 2)


def test_jaccard_join_in_parts(spark):
    """Boilerplate that half of every text shares, and near copies in it: groups in parts and clusters of many blocks lose no link."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"d{k}x{j}" for j in range(50 if k % 3 else 8)]
        if k % 5 == 4:
            own = [w if rng.random() > 0.02 else f"n{rng.randrange(10**6)}" for w in rows[-1][1].split()[60:]]
        rows.append((k, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute_components(rows)
    for longest_run, block in ((1 << 20, 512), (7, 16), (1, 4)):
        assert Counter(map(tuple, jaccard_join.link(docs, longest_run=longest_run, block=block).collect())) == want


def test_groups_come_whole_or_marked():
    rng = np.random.RandomState(3)
    key = np.sort(rng.randint(0, 9, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(np.arange(200)[i : i + 7])], ["k", "v"]) for i in range(0, 200, 7)]
    for most in (1, 5, 12, 1000):
        seen, parts = [], set()
        for (k, v), part in jaccard_join._groups(iter(batches), 2, most):
            assert not part or len(set(k.tolist())) == 1
            if not part:
                assert not set(k.tolist()) & parts and all((k == x).sum() == (key == x).sum() for x in set(k.tolist()))
            parts |= set(k.tolist()) if part else set()
            seen += v.tolist()
        assert seen == list(range(200))


def test_probes_avoid_frequent_shingles():
    """Texts that share half of their shingles with all others probe no group of that half alone."""
    t, rng = jaccard_join.Threshold(80), np.random.RandomState(4)
    draw = lambda: jaccard_join.mix(rng.randint(1, 1 << 62, 100).astype(np.uint64))
    common = draw()
    sets = [np.sort(np.concatenate([common, draw()])) for _ in range(50)]
    h, at = np.concatenate(sets), np.arange(51) * 200
    cost = np.zeros(jaccard_join.SLOTS, np.int64)
    cost[jaccard_join._slots(common)] = 50
    for given, most in ((None, 50), (cost, 1)):
        sig, row, role = jaccard_join.signatures(h, at, t, 0, 0, given)
        probed = np.unique(sig[role & 2 > 0])
        shared = [len(np.unique(row[sig == s])) for s in probed]
        assert (max(shared) > 10) == (most > 1)


def test_warc(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b c", None), (4, "u", ""), (None, "v", "<p>x</p>"), (5, "w", "é\r\n\r\nWARC/1.1"), (6, "w", "y" * 300_000)]
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shard_bytes=1000, file_bytes=600)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, folder).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    x, e = digest("<p>x</p>"), digest("")
    want = [(1, 8, x, "revisit", 2), (2, 8, x, "response", None), (2, 8, x, "revisit", 2), (None, 8, x, "revisit", 2), (3, 0, e, "revisit", 4), (4, 0, e, "response", None)]
    want += [(k, len(s.encode()), digest(s), "response", None) for k, s in ((5, rows[6][2]), (6, rows[7][2]))]
    assert got == Counter(want)
    again = shared_dir(spark, "warc-test")
    other = warc.write(spark.createDataFrame(rows[::-1], "page_id long, url string, html string"), again, shard_bytes=1000, file_bytes=600)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, other.collect()))


def test_token_files(spark, docs):
    folder = shared_dir(spark, "tokens-test")
    own = docs.where("doc_id is not null")
    manifest = token_bin.write(own, folder, BPE, shard_bytes=3000, file_tokens=500)
    assert manifest.where("sequence > 0").count() and manifest.where("shard > 0").count()
    library, start = Tokenizer.from_file(BPE), 0
    got = sorted(token_bin.read(spark, folder).collect(), key=lambda r: r["start"])
    for r, (i, text) in zip(got, sorted((r["doc_id"], r["text"] or "") for r in own.collect()), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (i, start, len(ids), ids.tolist(), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_of_uneven_keys(spark):
    """Outliers, one heavy key and null keys are cut too; shards ascend in the key and rows alike share one."""
    rows = [(k, f"t{k}") for k in range(300)] + [(10**18, "far"), (-(10**18), "near")] + [(77, f"same{k}") for k in range(200)] + [(None, f"none{k}") for k in range(200)] + [(5, "twin")] * 40
    table = spark.createDataFrame(rows, "id long, text string")
    dealt, shard, n = with_shard(table, "id", F.lit(1), 10, F.shiftrightunsigned(F.xxhash64("text"), 32))
    got = [(r["id"], r["text"], r[shard]) for r in dealt.collect()]
    assert Counter((i, t) for i, t, _ in got) == Counter(rows) and {s for *_, s in got} == set(range(n)) and n > 60
    size = Counter(s for i, t, s in got if t != "twin")
    assert max(size.values()) <= 40
    assert len({s for _, t, s in got if t == "twin"}) == 1
    ends = {}
    for i, _, s in got:
        i = -(10**19) if i is None else i
        low, high = ends.get(s, (i, i))
        ends[s] = min(low, i), max(high, i)
    order = [ends[s] for s in range(n)]
    assert all(a[1] <= b[0] for a, b in zip(order, order[1:], strict=False))
    again, shard, _ = with_shard(table.repartition(7), "id", F.lit(1), 10, F.shiftrightunsigned(F.xxhash64("text"), 32))
    assert Counter(got) == Counter((r["id"], r["text"], r[shard]) for r in again.collect())
    assert with_shard(table.limit(0), "id", F.lit(1), 10, F.lit(0))[2] == 1


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing(bits):
    ids = np.random.RandomState(bits).randint(0, 2**bits, 1001, dtype=np.int64)
    assert token_bin.unpack(token_bin.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()


def test_mixing(spark, docs):
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    got = mixing.sample(sized).collect()
    assert len(got) == len(_rows())
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]]
        rate = r["target"] / r["source_size"]
        assert math.floor(rate) <= r["copies"] <= min(2, math.ceil(rate))
    assert sorted(map(str, got)) == sorted(map(str, mixing.sample(sized.repartition(5)).collect()))
    assert mixing.sample(sized.limit(0)).count() == 0


def test_scoring(spark, docs):
    got = lbl_lm.score(docs, lang_id.fold("doc_id", 7) != 2).collect()
    counts, rows = Counter(), _rows()
    for i, text, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update([*_words(text), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, text, *_ in rows:
        own = [*_words(text), None]
        want[(i, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_scores_are_sums_of_class_probabilities(spark, docs):
    """The score of each text, token by token from the fitted model's own class probabilities and counts."""
    own = docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    train = F.col("doc_id") % 3 > 0
    got = {r["doc_id"]: r["score"] for r in lbl_lm.score(own, train).collect()}
    prepared = own.select(F.xxhash64("doc_id", "text").alias("key"), train.alias("train"), "text")
    counted = {r["word"]: r["n"] for r in lbl_lm.counts(prepared).collect()}
    v = lbl_lm.vocabulary(counted, {})
    model = lbl_lm.fit(prepared, v)
    of = {x: int(v.lookup(np.array([x]))[0][0]) for x in counted}
    share = {c: sum(counted[x] for x in of if of[x] == c) + sum(of[x] == c for x in of) + 1 for c in {*of.values(), *range(lbl_lm.CLASSES, lbl_lm.CLASSES + lbl_lm.TAILS)}}
    known = {}

    def log_p(one, two):
        if (one, two) not in known:
            s = (model.first[one] + model.second[two]).astype(float) @ model.out.T.astype(float) + model.bias
            known[one, two] = (s - s.max() - np.log(np.exp(s - s.max()).sum())) / math.log(10)
        return known[one, two]

    for r in own.where("length(text) < 3000 or text is null").collect():
        keys = [int(k) for w in words(pa.array([r["text"]])) for k in lbl_lm.keys_of(w)[0]]
        cls = [int(c) for c in v.lookup(np.array(keys))[0]]
        total = 0.0
        for i, (k, c) in enumerate(zip(keys, cls, strict=True)):
            total += log_p(cls[i - 1] if i else model.k, cls[i - 2] if i > 1 else model.k)[c]
            if c >= lbl_lm.CLASSES:
                total += math.log10((counted.get(k, 0) + 1) / share[c])
        assert math.isclose(got[r["doc_id"]], total, rel_tol=1e-3, abs_tol=1e-3), r["doc_id"]


def test_heads_are_counted_over_all_documents(spark):
    """Words common in one long document alone are heads as in a count of the whole table."""
    long = [(k, " ".join([f"rare{k}"] * 50), k % 5 != 0) for k in range(60)]
    rows = [*long, *((k, f"w{k % 9} x", True) for k in range(60, 12000))]
    docs = spark.createDataFrame(rows, "id long, text string, train boolean").select(F.xxhash64("id", "text").alias("key"), "train", "text")
    got = lbl_lm.commonest(docs)
    want = {lbl_lm.END, *(int(k) for w in words(pa.array([t for _, t, train in rows if train])) for k in lbl_lm.keys_of(w)[0])}
    assert set(got.tolist()) == want and len(want) == 48 + 10 + 1
    assert (np.diff(got) > 0).all()
    assert lbl_lm.commonest(docs.limit(0)).tolist() == [lbl_lm.END]


@pytest.mark.parametrize("top_level", [2, 4, 1 << 16])
@pytest.mark.parametrize("heads", [1, 3, 20, 41, 1000])
def test_heads_end_at_their_number(spark, monkeypatch, heads, top_level):
    """Ties at the last place go by key, whatever level of the histogram they are on."""
    monkeypatch.setattr(lbl_lm, "HEADS", heads)
    monkeypatch.setattr(lbl_lm, "_TOP_LEVEL", top_level)
    texts = [" ".join(f"w{k}" for k in range(40) for _ in range(1 + k % 4)), "w1 w2", None]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)] + [(9, "other " * 90, False)], "key long, text string, train boolean")
    counts = Counter(int(k) for w in words(pa.array(texts)) for k in lbl_lm.keys_of(w)[0])
    want = sorted(counts, key=lambda k: (-counts[k], k))[:heads]
    assert lbl_lm.commonest(docs).tolist() == sorted({lbl_lm.END, *want})


def test_class_probabilities_sum_to_one():
    model = lbl_lm.Model(np.full(20, 0.05))
    z = model.log_normalisers()
    s = (model.first[3] + model.second[7]) @ model.out.T + model.bias - z[3, 7]
    assert math.isclose(np.exp(s).sum(), 1, rel_tol=1e-5)


def _vectors():
    rng = np.random.RandomState(0)
    rows = [(k, rng.normal(size=8).tolist(), k % 3) for k in range(150)]
    hub = rng.normal(size=8)
    rows += [(200 + k, (hub + 0.03 * rng.normal(size=8)).tolist(), 1) for k in range(60)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, None, 1), (303, [0.0] * 8, 1), (304, [float("nan")] * 8, 1), (305, [None] * 8, 1), (306, rows[3][1], None), (307, rows[0][1], 0), (308, [1.0], 0), (309, [], 2)]
    return rows


@pytest.mark.parametrize("block", [8, 4096])
def test_vector_dedup(spark, block):
    rows = _vectors()
    got = {r["vec_id"]: r for r in vec_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16, block=block).collect()}
    fine = [(i, np.array(v, float), c) for i, v, c in rows if v and None not in v and np.isfinite(v).all() and any(v) and c is not None]
    links = {i: [j for j, w, d in fine if j != i and c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98] for i, v, c in fine}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, [])), min(seen), min(seen) == i)


def _nearest_hits(rows, got, k=20):
    """(found, all) of the true nearest, over queries of distinct ids."""
    fine = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for i, v in fine:
        if i % 20 == 0:
            want = sorted(((-(v @ w), j) for j, w in fine if j != i and len(v) == len(w)))[:k]
            own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, len(want) + 1))
            assert all(round(float(v @ dict(fine)[r["vec_id"]]), 9) == round(r["score"], 9) for r in own)
            hits, total = hits + len({j for _, j in want} & {r["vec_id"] for r in own}), total + len(want)
    return hits, total


def test_nearest(spark):
    rows = _vectors() + [(400, [2.0], 0), (401, [3.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    hits, total = _nearest_hits(rows, ivfpq.search(table, F.col("vec_id") % 20 == 0, k=20).collect())
    assert hits >= 0.95 * total
    assert ivfpq.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_by_the_index(spark):
    """A sample smaller than the table, fewer lists visited than there are, lists of several blocks."""
    rng = np.random.RandomState(4)
    centres = rng.normal(size=(120, 24))
    rows = [(k, (centres[k % 120] + 0.35 * rng.normal(size=24)).tolist(), 0) for k in range(9000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    x = np.array([r[1] for r in rows])
    index = ivfpq.Index(x[:4000], len(rows), 20)
    assert index.probes < len(index.centroids)
    got = ivfpq.search(table, F.col("vec_id") % 200 == 0, k=20, sample=4000).collect()
    hits = total = 0
    for i in range(0, 9000, 200):
        s = x @ x[i]
        s[i] = -np.inf
        want = set(np.lexsort((np.arange(9000), -s))[:20].tolist())
        own = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert len(own) == 20
        hits, total = hits + len(want & set(own)), total + 20
    assert hits >= 0.95 * total


def test_nearest_of_repeated_ids(spark):
    rows = [(k, [float(k), 1.0], 0) for k in range(1, 7)] + [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (20, [-1.0, 0.0], 0)]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, -1.0), (1, 6, 6.0), (2, 2, -2.0), (2, 5, 5.0)]


def test_one_kept_table_per_worker():
    from threadloom.llm import shared

    made = []
    shared.held("a", lambda: made.append("a") or "A")
    assert shared.held("a", lambda: made.append("again")) == "A"
    assert shared.held("b") is None
    shared.held("a", lambda: made.append("a") or "A")
    assert made == ["a", "a"]
    shared.held("none left")


def test_batch_bound_keeps_a_lower_one(spark):
    from threadloom.llm import shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("1000", "1000"), (str(1 << 30), str(4 << 20))):
            spark.conf.set(name, given)
            shared.small_batches(spark)
            assert spark.conf.get(name).removesuffix("b") == want
    finally:
        spark.conf.set(name, before)


def test_automaton_finds_the_longest_pattern():
    import itertools

    from threadloom.llm.automaton import automaton

    patterns = [b"a", b"ab", b"bab", b"bc", b"bca", b"c", b"caa"]
    go, row, longest, _ = automaton([(p, k) for k, p in enumerate(patterns)])
    for text in map(bytes, itertools.product(b"abcd", repeat=5)):
        state = 0
        for n, byte in enumerate(text, 1):
            state = go[row[state] + byte]
            ends = [p for p in patterns if text[:n].endswith(p)]
            assert longest[state] == (patterns.index(max(ends, key=len)) if ends else -1)
