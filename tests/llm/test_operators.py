"""Every corpus operator against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomery.llm import bpe, chat, decontaminate, exact_dedup, frames, jaccard_join, language_id, secrets, sharding, shingles, warc
from loomery.llm.perfect_hash import PerfectHash, Shard, as_words

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string"


def docs(spark, rows):
    """Rows of (doc_id, text), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", None, None, "x", "y") for d, t in rows], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text))


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for d in range(n):
        kind = rng.random()
        if rows and kind < 0.3:
            text = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            text = " ".join(text)
            text = text.upper() if kind < 0.03 else text
        elif kind < 0.4:
            text = rng.choice([None, "", "  \n", "one", "one two three", "Æther über x"])
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randrange(1, 90)))
            if rng.random() < 0.4:
                text += " " + passage
        rows.append((d, text))
    return rows


# ---- shingles


def test_shingle_sets_equal_sets_of_word_tuples():
    texts = [t or "" for _, t in corpus(1, 300)] + ["\n\t a\x0bb \r", "é" * 3 + " x", "a b c d e f " * 50]
    offsets, data = shingles.buffers(pa.array(texts))
    values, at = shingles.shingle_sets(offsets, data)
    names = {}
    for k, text in enumerate(texts):
        own = values[at[k] : at[k + 1]]
        assert len(own) == len(shingle_set(text))
        names.setdefault(frozenset(own.tolist()), set()).add(frozenset(shingle_set(text)))
    assert all(len(v) == 1 for v in names.values())


def test_shingle_chunks_cover_all_rows():
    offsets = np.array([0, 10, 10, 500, 501, 502])
    assert list(shingles.chunks(offsets, 12)) == [(0, 2), (2, 3), (3, 5)]


# ---- exact dedup


def test_perfect_hash_is_minimal_and_byte_checked():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    table = PerfectHash.build(as_words(keys))
    assert sorted(table.slots(as_words(keys))) == list(range(3000))
    shard = Shard(as_words(keys), [np.arange(3000)])
    again = Shard.load(**shard.dump())
    member, slot = again.find(as_words(keys))
    assert member.all() and (again.columns[0][slot] == np.arange(3000)).all()
    member, _ = again.find(as_words([hashlib.sha256(f"x{k}".encode()).digest() for k in range(5000)]))
    assert not member.any()
    assert PerfectHash.build(as_words([])).slots(as_words(keys[:2])).tolist() == [-1, -1]


def check_dedup(rows, out):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    assert len(out) == len(rows)
    kept = {}
    for r in out:
        own = groups[next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))]
        known = [d for d in own if d is not None]
        assert r["keep_id"] == (max(known) if known else None) and r["group_size"] == len(own)
        kept[bytes(r["digest"])] = kept.get(bytes(r["digest"]), 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_exact_dedup_against_groups(spark):
    rows = corpus(2, 200) + [(None, "one"), (None, None), (7, "repeated"), (7, "repeated"), (7, "REPEATED"), (8, "İ")]
    check_dedup(rows, exact_dedup.exact_dedup(docs(spark, rows)).collect())


def test_exact_dedup_hot_group_and_empty(spark):
    rows = [(k, "Hot Text" if k % 3 == 0 else f"text {k}") for k in range(4500)]
    out = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sum(r["kept"] for r in out) == 3001
    assert {r["keep_id"] for r in out if r["group_size"] > 1} == {4497}
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_exact_dedup_against_history(spark):
    past = docs(spark, [(1, "a"), (2, "A"), (3, "b")])
    new = docs(spark, [(10, "a"), (11, "c"), (12, "C"), (13, "d")])
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in exact_dedup.exact_dedup(new, past).collect()}
    assert out == {10: (2, 2, False, True), 11: (12, 2, False, False), 12: (12, 2, True, False), 13: (13, 1, True, False)}


def test_exact_dedup_of_very_long_texts_and_extreme_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "x" * 2_000_000), (5, "X" * 2_000_000), (low, "alone"), (high, "y"), (None, "Y"), (None, "z")]
    out = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    check_dedup(rows, out)
    assert {r["keep_id"] for r in out} == {5, low, high, None}


def test_drop_repeats_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (2, "A"), (3, None), (4, ""), (None, "n"), (None, "N"), (9, "z"), (9, "z"), (9, "y")]
    out = sorted((lower(r["text"]) for r in exact_dedup.drop_repeats(docs(spark, rows)).collect()))
    assert out == ["", "a", "n", "y", "z"]
    plain = docs(spark, [(1, "a"), (2, "A"), (3, "b")])
    kept = exact_dedup.drop_repeats(plain)
    assert kept.columns == plain.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


# ---- sharding


def jump(key, buckets):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 9, 60])
def test_jump_hash_equals_the_published_loop(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [random.Random(5).randrange(-(2**63), 2**63) for _ in range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    out = {r["k"]: r["shard"] for r in sharding.assign_shards(rows, "k", shards).collect()}
    assert out == {k: jump(k, shards) for k in keys}


def test_sharding_slots_and_growth(spark):
    rows = corpus(3, 400) + [(None, "x"), (None, None), (5, "again"), (5, "again")]
    out = sharding.shard_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.shard_documents(docs(spark, [])).collect() == []


# ---- token files


def test_token_files_round_trip_and_single_documents(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    odd = ["<|endoftext|>x <|startoftext|>", "a\x1cb\x85c d", "é ́x ΑΣ ΑΣΣ", "don't  stop's", "x" * 500 + " y", "\n\n \t"]
    rows = corpus(4, 60) + [(1000 + k, t) for k, t in enumerate(odd)] + [(5, "twice"), (5, "twice")]
    frames.write_token_files(docs(spark, rows), str(tmp_path / "ids"), path).collect()
    out = frames.read_token_files(spark, str(tmp_path / "ids")).collect()
    assert len(out) == len(rows)
    want = sorted((d, np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in rows)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in out) == want
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    some = frames.read_token_files(spark, str(tmp_path / "ids"), [5, 1003, 99999]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 5, 5, 1003]


def test_token_files_are_plain_zstd_and_notice_damage(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    writer = frames.FrameWriter(out)
    payloads = [np.arange(k, dtype="<u4").tobytes() for k in (3, 1, 700)]
    for k, p in enumerate(payloads):
        writer.add(k, p)
    writer.close()
    raw = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(payloads)
    reader = frames.FrameReader(io.BytesIO(raw), len(raw))
    assert [reader.frame(k).tobytes() for k in range(3)] == payloads
    reader.entries = reader.entries.copy()
    reader.entries[1, 2] ^= 1
    with pytest.raises(ValueError):
        reader.frame(1)
    with pytest.raises(ValueError):
        frames.FrameReader(io.BytesIO(b"x" * 40), 40)


def test_token_files_of_extreme_ids_and_other_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer

    low = -(1 << 63)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        vocabulary = public_tokenizers.path(name)
        rows = [(low, "one  Two"), (None, "three"), (None, ""), (7, " spaces  and\ttabs " * 50)]
        path = str(tmp_path / name)
        frames.write_token_files(docs(spark, rows), path, vocabulary).collect()
        out = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in frames.read_token_files(spark, path).collect()]
        plain = Tokenizer.from_file(vocabulary)
        assert sorted(out, key=repr) == sorted([(d, plain.encode(t, add_special_tokens=False).ids + [1]) for d, t in rows], key=repr)
        assert [r["doc_id"] for r in frames.read_token_files(spark, path, [low]).collect()] == [low]


def test_token_files_of_an_empty_table(spark, tmp_path):
    frames.write_token_files(docs(spark, []), str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert frames.read_token_files(spark, str(tmp_path / "none")).collect() == []


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "&lt;", "&", "<", "[", "]", "[SEP]", "é🙂", "\\", "\n", "", "plain", "&amp;lsqb;", "$1", "<<SYS>>"]
    rows, want = [], {}
    for c in [*range(25), None]:
        turns = []
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool]x", "", None])
            text = rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(6)))])
            turns.append((t, role or "", text or ""))
            rows.append((c, t, role, text, "extra"))
        want[c] = turns
    rng.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chats(made).collect()}
    assert back == {c: [(r, t) for _, r, t in turns] for c, turns in want.items()}
    loss = {r["conv_id"]: r["loss"] for r in made.select("conv_id", chat.loss_text(made).alias("loss")).collect()}
    assert loss == {c: "".join(t for _, r, t in turns if r == "assistant") for c, turns in want.items()}


def test_chat_ties_repeats_and_a_very_long_conversation(spark):
    rows = [(1, 0, "user", "b", "k"), (1, 0, "user", "a", "k"), (1, 0, "user", "a", "k"), (1, None, "assistant", "first", "k"), (1, 1, None, None, "k")]
    rows += [(2, k, "user" if k % 3 == 0 else "assistant", f"<{k}" * 3, "k") for k in range(3000)] + [(2, 3000, "assistant", "x[" * 200_000, "k")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, parts string")
    made = chat.format_chats(turns)
    loss = chat.loss_text(made)
    out = {r["conv_id"]: r for r in chat.parse_chats(made.withColumn("loss", loss), "loss").collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("assistant", "first"), ("user", "a"), ("user", "a"), ("user", "b"), ("", "")]
    want = [r for r in rows if r[0] == 2]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [(r[2], r[3]) for r in want]
    assert out[2]["loss"] == "".join(r[3] for r in want if r[2] == "assistant") and out[1]["loss"] == "first"


def test_chat_merges_neighbours_and_takes_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    assert chat.format_chats(spark.createDataFrame(rows, schema)).first()["formatted"] == "[INST]a[SEP]b[/INST]<s>c</s>"
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


# ---- decontamination


def plain_words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def bag(w):
    out = {}
    for k in range(max(1, len(w) - 4)):
        key = tuple(w[k : k + 5])
        out[key] = out.get(key, 0) + 1
    return out


def best_window(text, item):
    w, i = plain_words(text), plain_words(item)
    if not i or len(w) < len(i):
        return 0.0
    want, best = bag(i), 0.0
    for s in range(len(w) - len(i) + 1):
        own = bag(w[s : s + len(i)])
        shared = sum(min(n, want.get(k, 0)) for k, n in own.items())
        best = max(best, shared / (sum(own.values()) + sum(want.values()) - shared))
    return best


@pytest.mark.parametrize("table_limit", [1 << 19, 0])
def test_decontamination_finds_all_similar_windows(spark, monkeypatch, table_limit):
    monkeypatch.setattr(decontaminate, "MAX_TABLE_SHINGLES", table_limit)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 30, 60])))) for k in range(12)] + [(50, None), (51, "--"), (52, "a a a a a a a a a a")]
    rows = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if rng.random() < 0.6:
            leak = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if leak:
                    leak[rng.randrange(len(leak))] = "edit"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
        text = " ".join(text)
        rows.append((d, text.upper().replace(" ", ", ") if rng.random() < 0.3 else text))
    rows += [(100, None), (101, ""), (102, "a " * 40), (None, items[2][1])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, key string")
    out = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    want = {(d, i): s for (d, t), (i, it) in itertools.product(rows, items) if (s := best_window(t, it)) >= 0.8}
    assert set(out) == set(want)
    assert all(out[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("table_limit", [1 << 19, 0])
def test_decontamination_finds_truncated_items_as_whole_documents(spark, monkeypatch, table_limit):
    monkeypatch.setattr(decontaminate, "MAX_TABLE_SHINGLES", table_limit)
    rng = random.Random(9)
    item, other = (rng.choices([f"w{k}" for k in range(200)], k=40) for _ in range(2))
    texts = {1: item[:39], 2: item[3:], 3: item[:33], 4: item[:32], 5: item[:20], 6: item[:4], 7: item[1:39] + ["end"], 8: item}
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "x y z")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, [(d, " ".join(w)) for d, w in texts.items()]), bench).collect()
    out = {r["doc_id"]: (r["item_id"], r["similarity"], r["window_start"]) for r in found}
    assert len(out) == len(found)
    assert out == {d: (1, pytest.approx(n / whole), 0) for d, n, whole in ((1, 35, 36), (2, 33, 36), (3, 29, 36), (7, 34, 36 + 1), (8, 36, 36))}


def test_decontamination_tests_each_row_of_a_repeated_item_id(spark):
    rng = random.Random(11)
    base = rng.choices([f"w{k}" for k in range(200)], k=40)
    texts = [" ".join(base[:at] + ["edit"] + base[at + 1 :]) for at in range(0, 40, 2)]
    bench = spark.createDataFrame([(i, t) for i in (None, 5) for t in texts], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, list(enumerate(texts))), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == {(d, i): 1.0 for d in range(len(texts)) for i in (None, 5)}


def test_decontamination_index_selects_and_finds_leaks_near_the_threshold(spark, monkeypatch):
    """5,000 items of one length that share phrases; 1,000 leaks of similarity 0.8 to 0.86."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    phrases = [rng.choices(vocabulary, k=10) for _ in range(50)]
    items = [rng.choice(phrases) + rng.choices(vocabulary, k=30) for _ in range(5000)]
    rows = {}
    for d in range(1000):
        text, want = [*items[5 * d]], " ".join(items[5 * d])
        while True:
            trial = [*text]
            trial[rng.choice([0, 1, 2, 37, 38, 39])] = "edit"
            if rng.random() < 0.3:
                trial[rng.randrange(3)] = "more"
            if 0.8 <= best_window(" ".join(trial), want) <= 0.86:
                break
            text = trial if best_window(" ".join(trial), want) > 0.86 else [*items[5 * d]]
        rows[d] = rng.choices(vocabulary, k=5) + trial + rng.choices(vocabulary, k=5)
    seen, near = [], decontaminate.near_items

    def count(printed, index, radius):
        out = near(printed, index, radius)
        seen.append((out.count(), printed.count()))
        return out

    monkeypatch.setattr(decontaminate, "near_items", count)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, [(d, " ".join(w)) for d, w in rows.items()]), bench).collect()
    caught = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((d, 5 * d) in caught for d in rows) >= 990
    (pairs, windows), = seen
    assert windows >= 1000 and pairs < 5 * windows


def test_decontamination_of_repeated_rows_and_a_very_long_text(spark):
    rng = random.Random(18)
    item = rng.choices([f"w{k}" for k in range(200)], k=30)
    long = rng.choices([f"w{k}" for k in range(200)], k=60_000)
    long[50_000:50_000] = item
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(1, " ".join(long)), (2, " ".join(item)), (2, " ".join(item)), (None, " ".join(item))]
    found = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["similarity"], r["window_start"]) for r in found) == [(0, 1, 1.0, 0), (1, 1, 1.0, 50_000), (2, 1, 1.0, 0)]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, [(1, "a b c d e f")]), bench).collect() == []
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, []), full).collect() == []


# ---- BPE


def test_tree_codec_equals_the_library():
    codec = bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN, leaf=8)
    rng = random.Random(8)
    bits = ["the", " the", "  ", "\n", " ", "'s", "don't", "é", "🙂", "日本語", "　", "\x1c", "a" * 40, "123", "!?", "\t", "ﬁ", " x"]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(40)))
        ids = codec.encode(text)
        assert ids == codec.plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    long = " ".join(rng.choices(["alpha", "beta", "gamma"], k=30000))
    assert codec.encode(long) == codec.plain.encode_ordinary(long) and codec.decode(codec.encode(long)) == long.encode()


def test_tree_codec_joins_texts_without_cuts():
    rng = random.Random(19)
    pools = ["的一是不了人我在有他这中大来上国。，、！", "aaaaaaab", "ab'stredlvm", "abc019.,;-", "   \t\n\r\x1c\x85\u3000a", "éüñß łж あいう한국１２²½", "🙂👍🏽\u200d\u0301e"]
    codec = bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN, leaf=3)
    for k in range(1500):
        text = "".join(rng.choices(pools[k % 7] if k % 8 else "".join(pools), k=rng.randrange(1, 300)))
        assert codec.encode(text) == codec.plain.encode_ordinary(text)
    long = "".join(rng.choices(pools[0][:16], k=20_000))
    assert bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN).encode(long) == codec.plain.encode_ordinary(long)


def test_bpe_round_trip_rows(spark):
    rows = corpus(9, 30) + [(None, "x"), (3, "x y " * 5000)]
    out = bpe.round_trip(docs(spark, rows), RANKS, PATTERN).collect()
    plain = bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN).plain

    def expected(t):
        ids = plain.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(expected(t) for _, t in rows)
    ids = {tuple(r["ids"]) for r in bpe.encode_documents(docs(spark, rows), RANKS, PATTERN).collect()}
    assert ids == {tuple(plain.encode_ordinary(t or "")) for _, t in rows}
    assert bpe.round_trip(docs(spark, []), RANKS, PATTERN).collect() == []


# ---- language ID


def test_language_id_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(table.select("doc_id", "text"), language_id.train(table))
    joined = out.join(table.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(out["doc_id"])).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in joined)
    assert len(joined) > 150 and right / len(joined) > 0.95
    assert all(0 <= r["score"] <= 1 for r in joined)


def test_language_id_edge_rows(spark):
    rows = [(k, t, "aa" if k % 2 else "bb") for k, t in enumerate(["xyxyxy yyxyx xyyx", "mnmnm nnmmn mmnnm"] * 40)]
    train = spark.createDataFrame([*rows, (900, "zz", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.languages == ["aa", "bb"]
    odd = docs(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "mnmnm nnmmn"), (5, "qqqqqq"), (None, "xyxyxy"), (6, "é")])
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] == "aa" and out[None][0] == "bb" and out[5][0] in ("aa", "bb") and out[5][1] == 0.0 and out[6][0] in ("aa", "bb")
    nothing = language_id.train(train.filter("doc_id < 0"))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_language_id_ties_repeats_long_texts_and_many_languages(spark):
    one, two = "xyxyxy yyxyx xyyx", "mnmnm nnmmn mmnnm"
    train = spark.createDataFrame([(k, t, lang) for k in range(60) for t, lang in ((one, "bb"), (one, "cc"), (two, "aa"))], "doc_id long, text string, lang string")
    model = language_id.train(train)
    rows = [(1, one), (1, one), (2, " ".join([two] * 20_000)), (2, one + " " + two * 30_000)]
    out = [tuple(r) for r in language_id.identify(docs(spark, rows), model).collect()]
    assert out[0] == out[1] and out[0][1] == "bb" and out[2][1] == out[3][1] == "aa"
    kept = language_id.recognised(docs(spark, [*rows, (None, one), (3, None), (1, "12")]), model)
    assert kept.columns == docs(spark, []).columns and sorted((r["doc_id"] or 0, r["row"]) for r in kept.collect()) == [(0, "x"), (1, "x"), (1, "x"), (2, "x"), (2, "x")]
    many = [(f"l{k:03d}", " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}zq" for j in range(12))) for k in range(150)]
    wide = language_id.train(spark.createDataFrame([(10 * k + j, t, name) for k, (name, t) in enumerate(many) for j in range(8)], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, [(k, t) for k, (_, t) in enumerate(many)]), wide).collect()}
    assert len(wide.languages) == 150 and found == {k: name for k, (name, _) in enumerate(many)}


# ---- secrets


def base_by_rule(text):
    kinds = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def test_secret_patterns_equal_the_rule():
    rng = random.Random(10)
    bits = ["Password", "api_key", "APIKEY", "token", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "xyz.+/", "ſecret", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        assert secrets.base_spans(text) == base_by_rule(text)


def test_random_strings_by_token_efficiency(spark):
    key = "zQ8vK2mX9pL4wR7tB1nC6"
    rows = [(1, f"my key {key} here"), (2, None), (3, "d41d8cd98f00b204e9800998ecf8427e"), (4, "550E8400-E29B-41D4-A716-446655440000"), (5, "the_quick_brown_fox_version_2"), (6, f"token={key}"), (None, ""), (7, "internationalization standardization")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(docs(spark, rows), RANKS, PATTERN).collect()}
    assert found[1] == [("random", 7, 7 + len(key))]
    assert found[2] == found[4] == found[5] == found[7] == found[None] == []
    assert found[3] == [("hex", 0, 32)] and found[6] == [("assign", 0, 6 + len(key))]
    none = secrets.scan_secrets(docs(spark, rows[:1]), RANKS, PATTERN, known=frozenset([key])).first()["spans"]
    assert none == []


def ratio_by_rule(run):
    plain = bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN).plain
    return len(run) / len(plain.encode_ordinary(run))


def test_secret_scan_of_repeats_empty_tables_and_very_long_texts(spark):
    rng = random.Random(20)
    keys = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)) for _ in range(40)]
    keys = [k for k in keys if ratio_by_rule(k) < secrets.MAX_RATIO and not base_by_rule(k)]
    parts = [w for k in range(4000) for w in ("plain words of a text", f"password = hunter{k:08d}x", "d41d8cd98f00b204e9800998ecf8427e")]
    for at, key in enumerate(keys):
        parts.insert(at * 300 + 7, key)
    long = " ".join(parts)
    rows = [(1, long), (2, "token: abcdefghijkl"), (2, "token: abcdefghijkl"), (3, None)]
    found = secrets.scan_secrets(docs(spark, rows), RANKS, PATTERN).collect()
    assert [[tuple(s) for s in r["spans"]] for r in found[1:]] == [[("assign", 0, 19)]] * 2 + [[]]
    spans = [(s["start"], s["end"]) for s in found[0]["spans"] if s["kind"] == "random"]
    assert [long[a:b] for a, b in spans] == keys
    assert sorted((s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in found[0]["spans"] if s["kind"] != "random") == base_by_rule(long)
    assert secrets.scan_secrets(docs(spark, []), RANKS, PATTERN).collect() == []


def test_random_strings_of_one_case_or_letters_only_are_no_identifiers():
    test, rng = secrets.TokenEfficiency(RANKS, PATTERN), random.Random(12)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        low = [key for _ in range(300) if test.ratio(key := "".join(rng.choices(letters, k=32))) < secrets.MAX_RATIO]
        assert len(low) > 270
        assert sum(test.spans(key, [], secrets.MAX_RATIO, frozenset()) == [(0, 3, 32)] for key in low) >= 0.99 * len(low)
    assert test.spans("JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP", [], secrets.MAX_RATIO, frozenset())
    for name in ("node-12-of-34-in-rack-56", "the_quick_brown_fox_version_2", "internationalization", "2024-01-15/2024-02-01/2024"):
        assert not test.spans(name, [], secrets.MAX_RATIO, frozenset())


# ---- n-gram join


def components_by_force(rows):
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("seed", [11, 12])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = corpus(seed, 350) + [(None, "x y"), (3, "one"), (4, "another text of the same id here")]
    out = jaccard_join.jaccard_components(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    want = components_by_force(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in out)
    assert sorted(r["n_shingles"] for r in out) == sorted(len(shingle_set(t)) for _, t in rows)


def test_jaccard_large_groups_and_leader_rounds(spark):
    """Groups far larger than SMALL: chains of near copies and strangers that share a passage."""
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(2000)]
    base = rng.choices(vocabulary, k=60)
    rows = []
    for d in range(70):
        rows.append((d, " ".join(base)))
        if d % 3 == 0:
            base = list(base)
            base[rng.randrange(60)] = rng.choice(vocabulary)
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows += [(100 + k, f"{' '.join(rng.choices(vocabulary, k=4))} {passage} {' '.join(rng.choices(vocabulary, k=4))}") for k in range(60)]
    rows += [(200 + k, f"{' '.join(rng.choices(vocabulary, k=9))} {passage} {' '.join(rng.choices(vocabulary, k=9))}") for k in range(60)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert out == components_by_force(rows)


def test_jaccard_drift_of_many_versions(spark):
    """300 versions, each one word from the one before: one chain, whatever the order of ids."""
    rng = random.Random(15)
    text, rows = [f"c{k}" for k in range(100)], []
    for d in range(300):
        rows.append((d if d < 150 else 1000 - d, " ".join(text)))
        text = [*text]
        text[rng.randrange(100)] = f"n{d}"
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert out == components_by_force(rows)


@pytest.fixture
def counted(monkeypatch):
    """Pairs handed to verification, counted."""
    seen, verify = [], jaccard_join.verify

    def count(docs, ranks, pairs, percent):
        seen.append(pairs.count())
        return verify(docs, ranks, pairs, percent)

    monkeypatch.setattr(jaccard_join, "verify", count)
    return seen


def test_jaccard_shared_boilerplate_costs_no_pairs(spark, counted):
    """Pages at similarities from 0.6 to 0.79 by what they share, with words of their own: nothing links, few pairs are tested."""
    rows = []
    for k in range(20_000):
        own = (16, 28)[k % 2]  # words, four more than there are
        rows.append((k, " ".join([f"x{k}y{j}" for j in range(own - 4)] + [f"b{k % 2}w{j}" for j in range(104 - own)])))
    out = jaccard_join.jaccard_components(docs(spark, rows)).filter("doc_id <> component_id").count()
    assert out == 0 and sum(counted) < len(rows)


def test_jaccard_open_nodes_are_extended(spark, counted, monkeypatch):
    """Templates with a few choices each: members share early shingles with strangers and with relatives."""
    monkeypatch.setattr(jaccard_join, "FULL", 20)
    monkeypatch.setattr(jaccard_join, "FULL_CHILDREN", 0)
    rng = random.Random(16)
    forms = [[[f"f{f}p{p}c{c}" for c in range(3)] for p in range(4)] for f in range(2)]
    rows = []
    for k in range(400):
        form = forms[k % 2]
        part = [" ".join(f"{rng.choice(form[p])}w{j}" for j in range(2)) + f" {rng.choice(form[p])} " + " ".join(f"s{k % 2}q{p}z{j}" for j in range(6)) for p in range(4)]
        rows.append((k, " ".join(part)))
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert out == components_by_force(rows) and len(set(out.values())) > 5


def test_cells_compare_every_two_members_of_other_components_once(spark):
    rng = random.Random(23)
    rows = [(h, 1000 * h + d, rng.randrange(50, 60), rng.randrange(6), 0 if h == 2 else d % 5, size) for h, size in ((1, 300), (2, 200), (3, 20)) for d in range(size)]
    members = spark.createDataFrame(rows, "h long, doc long, n int, pos int, comp long, f long")
    out = [(r["a"], r["b"]) for r in jaccard_join.full_pairs(members, 1, 80).collect()]
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[4] != b[4] and jaccard_join._possible(a[2], a[3], b[2], b[3], 1, 80)}
    assert len(out) == len(set(out)) and set(out) == want and len(want) > 10_000


def test_jaccard_open_groups_give_fewer_links_than_members(spark, monkeypatch):
    """Versions with nine words of four choices each: hundreds share a shingle, few of their pairs link, many miss by little."""
    rng = random.Random(24)
    rows = []
    for k in range(500):
        text = [f"b{j}" for j in range(120)]
        for slot in range(9):
            text[6 + 13 * slot] = f"s{slot}c{rng.randrange(4)}"
        rows.append((k, " ".join(text)))
    seen, full = [], jaccard_join.full_pairs

    def count(members, level, percent):
        out = full(members, level, percent)
        seen.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "full_pairs", count)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1024)  # one cell a node
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert out == components_by_force(rows) and len(set(out.values())) > 100
    assert seen and all(0 < made < given for given, made in seen)


def test_cells_with_sets_connect_what_links(spark):
    """Parts of several sizes: the links given connect what all links of a node connect, from few rows."""
    rng = random.Random(25)
    rows, sets = [], {}
    for h, size in ((1, 300), (2, 40)):
        for d in range(size):
            form = 1000 * rng.randrange(1, 5)
            own = set(range(90)) | set(range(form, form + 20)) if d % 3 else set(rng.sample(range(10_000), 110))
            own -= set(rng.sample(range(90), 3))
            values = np.array(sorted(own), np.uint64)
            sets[1000 * h + d] = own
            rows.append((h, 1000 * h + d, len(own), rng.randrange(4), d % 200, size, values.tobytes()))
    members = spark.createDataFrame(rows, "h long, doc long, n int, pos int, comp long, f long, items binary")
    out = {(r["a"], r["b"]) for r in jaccard_join.full_pairs(members, 1, 80).collect()}
    every, given = jaccard_join.Forest(), jaccard_join.Forest()
    linked = 0
    for a, b in itertools.combinations(rows, 2):
        x, y = sets[a[1]], sets[b[1]]
        if a[0] == b[0] and a[4] != b[4] and jaccard_join._possible(a[2], a[3], b[2], b[3], 1, 80) and 100 * len(x & y) >= 80 * len(x | y):
            linked += 1
            every.joining(np.array([a[0] * 10_000 + a[4]]), np.array([b[0] * 10_000 + b[4]]))
        elif (a[1], b[1]) in out or (b[1], a[1]) in out:
            raise AssertionError("a pair that does not link")
    comp = {r[1]: r[0] * 10_000 + r[4] for r in rows}
    for a, b in out:
        given.joining(np.array([comp[a]]), np.array([comp[b]]))
    names = sorted(set(comp.values()))
    same = [[f.root(x) for x in names] for f in (every, given)]
    assert len(set(zip(*same, strict=True))) == len(set(same[0])) == len(set(same[1]))
    assert linked > 2000 and len(out) < 9 * 300


@pytest.mark.parametrize(("values", "columns"), [(1 << 19, 1 << 12), (50, 7)])
def test_overlaps_and_linked_sets_equal_intersections(monkeypatch, values, columns):
    monkeypatch.setattr(jaccard_join, "_VALUES", values)
    monkeypatch.setattr(jaccard_join, "_COLUMNS", columns)
    rng = random.Random(26)
    for _ in range(30):
        base = rng.sample(range(1 << 40), 60)
        left, right = ([np.array(rng.sample(base, rng.randrange(1, 60)) + rng.sample(range(1 << 41, 1 << 42), rng.randrange(5)), np.uint64) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        left[0] = right[0]
        want = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left])
        assert (jaccard_join.overlaps(left, right) == want).all()
        asked = np.array([[rng.random() < 0.7 for _ in right] for _ in left])
        links = np.array([[100 * want[i, j] >= 80 * (len(x) + len(y) - want[i, j]) for j, y in enumerate(right)] for i, x in enumerate(left)])
        assert (jaccard_join.linked_sets(left, right, asked, 80) == (asked & links)).all()


def test_jaccard_very_long_and_repeated_rows(spark):
    rng = random.Random(17)
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    near = [*long]
    for k in range(0, 40_000, 300):
        near[k] = "edit"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:20_000])), (4, "a b"), (4, "a b"), (5, "A B"), (6, None)]
    out = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, rows)).collect())
    assert out == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6)]


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).collect() == []


def test_prefix_tree_equals_intersections():
    rng = random.Random(14)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 30))), np.uint64) for _ in range(rng.randrange(1, 8))]
        probe = np.array(rng.sample(range(40), rng.randrange(1, 30)), np.uint64)
        tree = jaccard_join.PrefixTree(sets)
        tree.STEP = 3
        want = [100 * len(set(s) & set(probe)) >= 80 * len(set(s) | set(probe)) for s in sets]
        assert tree.linked(probe, 80) == want


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "x" * 200, "<p>tiny"
    rows = [(5, "http://a/1", big), (3, "http://b", big), (9, None, small), (8, "u v\r\nX: y", small), (1, "http://c", None), (2, "", "é" * 80), (11, "http://a/1", "é" * 80)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string")
    warc.write_archives(pages, str(tmp_path / "w")).collect()
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows)
    out = {r["page_id"]: r for r in warc.page_captures(warc.assemble(records)).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (out[page]["payload_bytes"], out[page]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {p: r["refers_to"] for p, r in out.items() if r["record_type"] == "revisit"} == {5: 3, 11: 2}


def test_warc_repeated_and_null_ids(spark, tmp_path):
    big = "y" * 300
    pages = spark.createDataFrame([(4, "u", big), (4, "u", big), (None, "n", big), (None, None, "z")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w")).collect()
    out = warc.page_captures(warc.assemble(warc.read_archives(spark, str(tmp_path / "w"), payloads=False))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in out) == [(0, "response", 0), (0, "revisit", 4), (4, "response", 0), (4, "revisit", 4)]
    none = warc.write_archives(pages.filter("page_id = 77"), str(tmp_path / "none")).collect()
    assert none == [] and warc.page_captures(warc.assemble(warc.read_archives(spark, str(tmp_path / "none")))).collect() == []


def test_warc_assembly_follows_chains_and_keeps_orphans(spark):
    def record(i, kind, to=()):
        return (i, kind, None, None, list(to), None, 0, None, None)

    rows = [record("r1", "response", ["q1"]), record("q1", "request"), record("m1", "metadata", ["q1"]), record("m2", "metadata", ["m1"]), record("r2", "response"), record("lost", "request", ["nowhere"])]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert [m["record_id"] for m in out["r1"]["metadata"]] == ["m1", "m2"] and [q["record_id"] for q in out["r1"]["requests"]] == ["q1"]
    assert out["r2"]["requests"] is None and out["lost"]["response"] is None and len(out) == 3


def test_warc_assembly_follows_any_chain_and_records_that_name_nothing(spark):
    def record(i, kind, to=()):
        return (i, kind, None, None, list(to), None, 0, None, None)

    rows = [record("r", "response", ["m00"]), *[record(f"m{k:02d}", "metadata", [f"m{k + 1:02d}"]) for k in range(20)], record("m20", "metadata")]
    rows += [record("s", "response"), record("q", "request", ["s", "x"]), record("x", "metadata")]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert [m["record_id"] for m in out["r"]["metadata"]] == [f"m{k:02d}" for k in range(21)]
    assert [m["record_id"] for m in out["s"]["metadata"]] == ["x"] and [q["record_id"] for q in out["s"]["requests"]] == ["q"] and len(out) == 2


def test_warc_of_a_very_long_page(spark, tmp_path):
    big = "é" * 3_000_000
    pages = spark.createDataFrame([(2, "u", big), (1, "v", big), (3, "w", "")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w")).collect()
    out = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_captures(warc.assemble(warc.read_archives(spark, str(tmp_path / "w"), payloads=False))).collect())
    assert out == [(1, 6_000_000, "response", None), (2, 6_000_000, "revisit", 1), (3, 0, "response", None)]


def test_warc_reader_takes_plain_files_and_refuses_damage(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nX-Folded: a\r\n b\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(one)
    row = warc.read_archives(spark, str(tmp_path / "w")).first()
    assert row["payload_digest"] == hashlib.sha256(b"hello").hexdigest() and row["payload_bytes"] == 5
    (tmp_path / "w" / "a.warc").write_bytes(one[:-12])
    with pytest.raises(Exception, match="ends early"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()


def test_parity_bits_never_understate_the_overlap():
    rng = np.random.default_rng(15)
    for _ in range(300):
        common = rng.integers(0, 1 << 63, rng.integers(0, 900), dtype=np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(1, 3000), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        assert jaccard_join.overlap_bound(len(a), jaccard_join.parity_bits(a), len(b), jaccard_join.parity_bits(b)) >= shared
    far = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(2)]
    assert jaccard_join.overlap_bound(500, jaccard_join.parity_bits(far[0]), 500, jaccard_join.parity_bits(far[1])) < jaccard_join.needed_overlap(1000, 80)
