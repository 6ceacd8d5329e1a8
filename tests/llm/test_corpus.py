"""Near-dedup, mixing, suffix dedup, token shards and the whole pipeline, against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination, failed, fingerprint, groups, level_of, mix, near_copies, quality, repeats
from test_clean import LONG, ODD, frame

from chronograft.llm import anchors, copies, mixing, q_simhash, q_substrings, q_tokens, simhash, substrings, suffix, tokens
from chronograft.llm.components import components
from pyspark.sql import functions as F

VOCABULARY = [f"{a}{b}" for a in "the of Réa xi ou Za".split() for b in ("n", "ter", "ion", "ß", "")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
    return " ".join(w)


def copies_of(texts):
    """Index of the first member of each text's group of near copies, by all pairs of texts."""
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and near_copies(texts[i], texts[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


# near-dedup


def test_fingerprints():
    rnd = random.Random(2)
    for t in [None, "", " \n", "a", "a b", "A B c", "a b c d", "x\x1cy\xa0z", *(prose(rnd, rnd.randint(1, 60)) for _ in range(40)), LONG]:
        assert simhash.fingerprint(t) == fingerprint(t)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [2048, 6])
def test_links_reach_what_brute_force_reaches(spark, bucket):
    """Clusters that spread by a few bits, with buckets small enough to be refined."""
    rnd = random.Random(bucket)
    fps = {0, (1 << 64) - 1, 7}
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(rnd.choice((1, 3, 60))):
            fps.add(at)
            if rnd.random() < 0.3:
                at ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            else:
                fps.add(at ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    fps = sorted(fps)
    items = spark.createDataFrame([(_signed(x),) for x in fps], "fp long")
    root = dict(components(simhash.links(items, bucket)).collect())
    assert components(simhash.links(items.limit(0), bucket)).count() == 0
    want = groups(fps)
    got = [root.get(_signed(x), _signed(x)) for x in fps]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_forest_is_whole():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    items = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 5), replace=False))) for _ in range(300)], np.uint64))
    u, v = simhash.forest(items)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    got = [root.get(int(x), int(x)) for x in items]
    want = groups([int(x) for x in items])
    assert got == [int(items[g]) for g in want]


def test_simhash_query(spark, tmp_path):
    rnd = random.Random(8)
    base = [prose(rnd, 120) for _ in range(6)]
    texts = ODD + [edited(rnd, b, n) for b in base for n in (0, 0, 1, 2, 3)]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "lonely text here")], "doc_id long, text string").withColumn("fp", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = q_simhash.op1_simhash(spark, str(tmp_path)).collect()
    rows = docs.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    group = groups(fps)
    least = {g: min((r["doc_id"] for r, x in zip(rows, group, strict=True) if x == g and r["doc_id"] is not None), default=None) for g in group}
    want = sorted(map(str, ((r["doc_id"], format(f, "016x"), least[g]) for r, f, g in zip(rows, fps, group, strict=True))))
    assert sorted(map(str, map(tuple, got))) == want
    kept = copies.keep_one_each(docs)
    group = copies_of([r["text"] for r in rows])
    least = {g: min((r["doc_id"] for r, x in zip(rows, group, strict=True) if x == g and r["doc_id"] is not None), default=None) for g in group}
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and copies.keep_one_each(docs.limit(0)).count() == 0


def test_chain_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)], "u long, v long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, 50)}


# mixing


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "b", "Z", "é", None]), prose(rnd, rnd.randint(0, 40)) if i % 9 else None) for i in range(400)]
    rows += [(None, "b", "null id"), (5000, "tiny", "one"), (5001, "none", ""), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("size", "copies", "key", "target", "n", "m")})
    size, total, target, copies = mix(rows)
    got = mixing.plan_mix(docs).collect()
    told = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in got), key=str)
    assert told == sorted(((r[0], z, total[r[1]], round(target[r[1]], 6), c) for r, z, c in zip(rows, size, copies, strict=True)), key=str)
    assert all(r["copies"] <= 3 for r in got)
    for s, words in total.items():
        taken = sum(c * z for r, z, c in zip(rows, size, copies, strict=True) if r[1] == s)
        assert abs(taken - target[s]) <= max((z for r, z in zip(rows, size, strict=True) if r[1] == s), default=0) and words >= 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    many = sorted(map(str, ((r["doc_id"], r["source"], r["text"]) for r in mixed.collect())))
    assert many == sorted(str(r) for r, c in zip(rows, copies, strict=True) for _ in range(c))
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_inclusion_follows_the_measure(spark):
    """120 sources are 120 draws: documents of more than their share are certain, the others as frequent as solved for."""
    mine = [("x " * 200).strip()] + ["y " * 8] * 20 + ["z z"] * 400
    rows = [(1000 * s + i, f"s{s:03d}", t) for s in range(120) for i, t in enumerate(mine)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = 200 + 160 + 800
    level = level_of(total / 2, [(len(t.split()), len(t.split()).bit_length()) for t in mine])
    assert 8 * level > 1 > 4 * level
    sampled = [0, 0, 0]
    for r in mixing.plan_mix(docs, weights=(1, 3)).collect():
        i = r["doc_id"] % 1000
        sampled[min(i, 1) + (i > 20)] += r["copies"] - (r["target"] > total)
    assert sampled[0] == 120
    for got, n, p in ((sampled[1], 2400, 4 * level), (sampled[2], 48000, 2 * level)):
        assert abs(got / n - p) < 4 * (p * (1 - p) / n) ** 0.5, (got / n, p)


def test_rows_without_an_id_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "s", f"text {i}") for i in range(60)] + [(1, "t", "a b " * 30)], "doc_id long, source string, text string")
    copies_ = {r["copies"] for r in mixing.plan_mix(docs, weights=(2, 3)).where("source = 's'").collect()}
    assert len(copies_) == 2


def test_targets_fill_up(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 1)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(t).collect()}
    assert got == {"a": (1, 30.0), "b": (2, 958.0), "c": (3, 30.0), None: (1, 3.0)}
    empty = spark.createDataFrame([("a", 0)], "source string, source_size long")
    assert mixing.targets(empty).first()["target"] == 0.0


# suffix dedup


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, k = int(rng.integers(1, 80)), int(rng.integers(2, 6))
        t = np.append(rng.integers(1, k, n), 0).astype(np.uint16)
        text = t.tolist()
        sa = suffix.suffix_array(t, k)
        want = sorted(range(n + 1), key=lambda i: text[i:])
        assert sa.tolist() == want
        common = suffix.common_prefixes(t, sa)
        for i, j in zip(want[1:], want, strict=False):
            same = next((x for x in range(n + 1) if max(i, j) + x > n or text[i + x] != text[j + x]))
            assert common[i] == same


@pytest.mark.parametrize("group_bytes", [substrings.GROUP_BYTES, 5_000, 0])
def test_repeats(spark, tmp_path, group_bytes):
    rnd = random.Random(9)
    shared = [prose(rnd, 60), prose(rnd, 45), "中é" * 60]
    texts = [prose(rnd, rnd.randint(1, 40)) + rnd.choice(["", *shared]) + prose(rnd, 30) + rnd.choice(["", *shared]) for _ in range(40)]
    texts += [None, "", "short", "short", "a" * 199, "a" * 200, "b" * 200 + "c", "d" * 450, "ab" * 300, shared[0] + shared[0], "q" * 201, "x" + shared[0][:199], shared[1], shared[1], texts[0]]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "did", "anchor", "runs", "kept")})
    want = sorted(map(str, ((i if i % 7 else None, *r) for i, r in enumerate(repeats(texts)))))
    got = substrings.repeats(docs, group_bytes=group_bytes)
    told = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()]
    assert sorted(map(str, told)) == want
    assert substrings.repeats(docs.limit(0)).count() == 0
    if group_bytes == substrings.GROUP_BYTES:
        docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
        import hashlib

        sums = sorted(map(str, ((i if i % 7 else None, *r[:3], hashlib.sha256(r[3]).hexdigest()) for i, r in enumerate(repeats(texts)))))
        assert sorted(map(str, map(tuple, q_substrings.op4_suffix_dedup(spark, str(tmp_path)).collect()))) == sums


def test_runs_of_one_byte_and_periods():
    import time

    rnd = random.Random(4)
    parts = [*(c * n for c in "ab" for n in (150, 199, 200, 201, 399, 400, 401, 402, 900)), "ab" * 150, "abc" * 200, "x", "yz" * 3, prose(rnd, 40)]
    for _ in range(30):
        segments = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))).encode() for _ in range(4)]
        segments = [s for s in segments if len(s) >= 200]
        windows = [s[i : i + 200] for s in segments for i in range(len(s) - 199)]
        want = [[windows.count(s[i : i + 200]) > 1 for i in range(len(s) - 199)] for s in segments]
        assert [x.tolist() for x in substrings.repeated_windows(segments)] == want
    for data in (b"a" * (4 << 20), b"ab" * (1 << 20), bytes(range(97, 122)) * 40_000):
        began = time.process_time()
        assert substrings.repeated_windows([data])[0].all()
        assert time.process_time() - began < 30


def test_refined_runs_tell_windows_apart():
    rnd = random.Random(6)
    data = ("a" * 300 + prose(rnd, 60) + "ab" * 120 + prose(rnd, 20)).encode()
    windows = [data[i : i + 200] for i in range(len(data) - 199)]
    for level in (1, 3, 255):
        first, count, key = anchors.refined(data, level)
        assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(windows)
        of = np.repeat(key, count).tolist()
        by = {}
        assert all(by.setdefault(w, k) == k for w, k in zip(windows, of, strict=True))
    assert len(set(of)) == len(set(windows))


def test_pieces(monkeypatch):
    rnd = random.Random(7)
    monkeypatch.setattr(substrings, "PIECE", 300)
    texts = [prose(rnd, 400).encode(), b"", b"x" * 199, prose(rnd, 38).encode()]
    for t, r in zip(texts, substrings._runs_of(texts), strict=True):
        covered = sorted(i for f, n in zip(r[1].tolist(), r[2].tolist(), strict=True) for i in range(f, f + n))
        assert covered == list(range(max(0, len(t) - 199)))


def test_one_very_long_text(spark):
    rnd = random.Random(3)
    a, b = prose(rnd, 30_000), prose(rnd, 100)
    texts = [a[:90_000] + b + a[90_000:] + b, "e" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substrings.repeats(docs).collect()}
    assert got == {i: r[1:3] for i, r in enumerate(repeats(texts))}


# token shards


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = tokens.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and np.array_equal(tokens.unpack(data, bits, n), ids)


def test_encoder_is_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 300)
    enc = tokens.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    assert enc.bits == 16
    rnd = random.Random(5)
    parts = [*"abAB,.'<|>!?#é́ßİΣς  \n\t\r\x0b\x1c١²Ⅷ中あ한👍_-&;*$%\"", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ﬁ", "̸", "="]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(2500)] + [prose(rnd, 200), LONG, ""]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_shards(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    texts = ODD + [prose(rnd, rnd.randint(0, 300)) for _ in range(60)]
    rows = [(900 - i, t) for i, t in enumerate(texts)] + [(None, "no id"), (900, None), (7, "again a"), (7, "again a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "h", "path", "start")})
    whole = tokens.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json")).tokenizer
    ids = {r: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    manifest = tokens.write_tokens(docs)
    got = sorted(tokens.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["value"])
        at += r["n_tokens"]
    assert sorted(map(str, ((r["id"], r["value"]) for r in got))) == sorted(map(str, ((r[0], ids[r]) for r in rows)))
    digest = q_tokens.digest(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in digest))) == sorted(
        map(str, ((r[0], len(ids[r]), zlib.crc32(np.array(ids[r], "<u4").tobytes())) for r in rows)))
    row = manifest.orderBy("shard").collect()[-1]
    store, _ = tokens._open(row["path"].rsplit("/", 1)[0])
    with store.open_input_file(tokens._open(row["path"])[1]) as f:
        shard = tokens.ShardReader(f)
        mine = [r["value"] for r in got if r["start"] >= row["start"]]
        flat = [x for v in mine for x in v]
        for _ in range(50):
            lo = rnd.randrange(len(flat))
            hi = rnd.randint(lo, len(flat))
            assert shard.ids(lo, hi).tolist() == flat[lo:hi]
        assert shard.document(len(mine) - 1).tolist() == mine[-1]
    empty = tokens.write_tokens(docs.limit(0))
    assert empty.count() == 0 and tokens.read_tokens(empty).count() == 0


def test_every_tokenizer_file_gives_whole_text_ids():
    import os

    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = ["", " ", "Hello  World's\t\n x", "e\u0301 É ß İ ſ 中文 \u00a0\u3000y", "<|endoftext|> <|x", "a" * 300, "1234 we'll THEY'RE", *(prose(rnd, 30) for _ in range(20))]
    texts += ["".join(rnd.choice("aB é\u0301.,'s<|1 \n\t中") for _ in range(40)) for _ in range(100)]
    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    seen = 0
    for file in sorted(os.listdir(folder)):
        path = os.path.join(folder, file)
        if file.endswith(".json"):
            whole = Tokenizer.from_file(path)
            want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        elif file.endswith(".tiktoken"):
            import base64

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = [whole.encode_ordinary(t) for t in texts]
        elif file.endswith(".model"):
            want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
        else:
            continue
        seen += 1
        encoder = tokens.Encoder(path)
        assert [x.tolist() for x in encoder.encode(texts)] == want, file
        assert max(map(max, filter(None, want))) < 1 << encoder.bits
        assert (encoder.known is not None) == (file == "word_bpe_49k.json")
    assert seen == 5
    with pytest.raises(ValueError):
        tokens.Encoder("vocabulary.txt")


def test_small_blocks():
    sink = pa.BufferOutputStream()
    w = tokens.ShardWriter(sink, 5, block=8)
    docs = [np.arange(n, dtype="<u4") % 32 for n in (0, 3, 8, 40, 1)]
    for d in docs:
        w.add(d)
    w.close(pa.chunked_array([pa.array([None, "a", "b", "c", "d"])]))
    r = tokens.ShardReader(pa.BufferReader(sink.getvalue()))
    assert [r.document(i).tolist() for i in range(5)] == [d.tolist() for d in docs] and r.names.to_pylist() == [None, "a", "b", "c", "d"]
    assert r.n_blocks == 7 and r.ids(6, 19).tolist() == np.concatenate(docs)[6:19].tolist()


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    items = [(i, prose(rnd, 12)) for i in range(5)]
    good = [prose(rnd, rnd.randint(60, 140)) for _ in range(40)]
    texts = good + [edited(rnd, g, n) for g in good[:10] for n in (0, 0, 1)] + [g + " " + items[i % 5][1] + " ende" for i, g in enumerate(prose(rnd, 80) for _ in range(6))] + ODD[:-1]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = sorted(r for r in rows if failed(quality(r[1])) == 0)
    group = copies_of([r[1] for r in left])
    left = [r for i, r in enumerate(left) if group[i] == i]
    left = [r for r in left if not contamination(r[1], items)[2]]
    *_, copies = mix([(r[0], r[3], r[1]) for r in left])
    whole = tokens.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json")).tokenizer
    want, at = [], 0
    for r, c in zip(left, copies, strict=True):
        ids = [*whole.encode(r[1], add_special_tokens=False).ids, 1]
        for _ in range(c):
            want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert 30 < len(left) <= len(good)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark):
    docs = frame(spark, ODD)
    for f in (copies.keep_one_each, mixing.mix):
        assert f(docs).columns == docs.columns


@pytest.mark.parametrize("bucket,shingles", [(2048, 1 << 21), (10, 3000)])
def test_edited_copies_are_found(spark, monkeypatch, bucket, shingles):
    """All pairs by brute force: exact finds every group, buckets nearly all, and neither joins what isn't alike."""
    monkeypatch.setattr(copies.links, "__defaults__", (*copies.links.__defaults__[:2], bucket, False))
    monkeypatch.setattr(copies, "SHINGLES", shingles)
    rnd = random.Random(21)
    long_words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rnd.choice(long_words) for _ in range(n))
    base = [say(rnd.choice((60, 150, 400))) for _ in range(25)]
    passage = say(60)
    changed = [" ".join(rnd.choice(long_words) if rnd.random() < rate else w for w in b.split(" ")) for b in base for rate in (0.01, 0.03, 0.06, 0.09, 0.12, 0.3)]
    apart = [say(60) + " " + passage + " " + say(60) for _ in range(30)]
    texts = [*base, *changed, *apart, *base[:3], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(copies_of(texts))
    assert len(texts) - len(want) > 100 and set(range(len(base) + len(changed), len(base) + len(changed) + 30)) <= want
    assert {r["doc_id"] for r in copies.keep_one_each(docs, exact=True).collect()} == want
    kept = {r["doc_id"] for r in copies.keep_one_each(docs).collect()}
    assert kept >= want and len(texts) - len(kept) > 0.95 * (len(texts) - len(want))


def test_repeated_phrase(spark):
    """Texts that repeat the same line beside words of their own stay apart."""
    rnd = random.Random(31)
    line = " ".join(f"line{i}" for i in range(12))
    own = [[f"w{d}x{i}" for i in range(n)] for d in range(60) for n in (324, 40)]
    texts = [" ".join([*w[: len(w) // 2], *[line] * 15, *w[len(w) // 2 :]]) for w in own]
    texts += [edited(rnd, t, 2) for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in copies.keep_one_each(docs).collect()} == set(copies_of(texts)) == set(range(120))


def test_similarity_at_the_threshold():
    """Jaccard similarities of 0.8, and shares of words of 0.8, to the word."""
    rnd = random.Random(37)
    words = rnd.sample([f"w{i}" for i in range(30000)], 700)

    def alike(*texts):
        return copies.Shingled([copies.shingle_hashes(t, 5) for t in texts]).alike(0, 1, 0.8)

    def block(n, m):
        """``m`` words put into a text of ``n``."""
        return " ".join(words[:n]), " ".join([*words[:100], *words[n : n + m], *words[100:n]])

    def changed(n):
        """Every tenth word changed, in a text of 300, and the last ``n`` words."""
        w = [words[300 + i] if i % 10 == 0 else words[i] for i in range(300 - n)] + words[400 : 400 + n]
        return " ".join(words[:300]), " ".join(w)

    for pair in [block(256, 24), block(256, 64), block(256, 65), changed(0), changed(30), changed(36), changed(40), changed(60)]:
        assert alike(*pair) == alike(*pair[::-1]) == near_copies(*pair)
    assert near_copies(*block(256, 24)) and near_copies(*changed(0)) and not near_copies(*block(256, 80)) and not near_copies(*changed(60))


@pytest.mark.parametrize("max_bits", [3, 40, 80])
def test_pivot_tables_lose_no_pair(max_bits):
    rnd = np.random.default_rng(max_bits)
    base = rnd.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    noise = (rnd.random((400, 256)) < rnd.choice([0, 0.01, 0.1, 0.2], 400)[:, None]).astype(np.uint8)
    bits = base[rnd.integers(0, 12, 400)] ^ np.packbits(noise, axis=1, bitorder="little").view("<u8")
    got = {(int(a), int(b)) for i, j in copies.near_pairs(bits, max_bits) for a, b in zip(i, j, strict=True)}
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if far[i, j] <= max_bits} and got


@pytest.mark.parametrize("common", [1, 3, 12, 1000])
def test_forest_of_copies_is_whole(monkeypatch, common):
    """Texts around shared passages, whatever number of texts makes a shingle common."""
    monkeypatch.setattr(copies, "COMMON", common)
    rnd = random.Random(common)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [say(40), say(25)]
    texts = [say(rnd.choice((4, 30))) + " " + rnd.choice(passages) + " " + say(rnd.choice((4, 30))) for _ in range(60)]
    texts += [" ".join(rnd.choice(words) if rnd.random() < 0.04 else w for w in t.split(" ")) for t in texts for _ in range(2)]
    u, v = copies.forest(np.arange(len(texts)), np.array([copies.wide_fingerprint(t)[0] for t in texts]), [simhash.shingle_hashes(t, 5) for t in texts], 256, 0.8)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert [root.get(i, i) for i in range(len(texts))] == copies_of(texts)


def test_dense_buckets_are_fast():
    import time

    rnd = np.random.default_rng(1)
    bits = np.repeat(rnd.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 2048, axis=0)
    began = time.process_time()
    assert copies.candidates(bits, np.zeros((2048, copies.KEYS), np.uint64), 0, 80).all()
    assert time.process_time() - began < 4


@pytest.mark.parametrize("hub", [1000, 3])
def test_components_with_hubs(spark, monkeypatch, hub):
    from chronograft.llm import components as C

    monkeypatch.setattr(C, "HUB", hub)
    rnd = random.Random(hub)
    links = [(7, i) for i in range(100, 180)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    root = {x: x for u, v in links for x in (u, v)}
    for u, v in links:
        a, b = root[u], root[v]
        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    df = spark.createDataFrame(links, "u long, v long")
    assert dict(components(df).collect()) == {x: r for x, r in root.items() if x != r}
