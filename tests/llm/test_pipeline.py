"""The pipeline on a planted corpus against a brute-force version of all its stages."""

import hashlib
import random

import corpus_pipeline
from loomery.llm import bpe
from tests.llm.test_operators import PATTERN, RANKS, best_window, components_by_force, lower


def planted(seed=21):
    rng = random.Random(seed)
    tongues = {"aa": [a + b + c for a in "ktp" for b in "ao" for c in "rnl"], "bb": [a + b + c for a in "szv" for b in "ei" for c in "mgd"]}
    items = [(k, " ".join(rng.choices(tongues["aa" if k % 2 else "bb"], k=25))) for k in range(4)]
    rows = []
    for d in range(160):
        lang = rng.choice(["aa", "bb"])
        kind = rng.random()
        if rows and kind < 0.15:
            _, text, lang = rng.choice([r for r in rows if r[1] and r[1].strip()])
            text = text.upper() if kind < 0.05 else text
        elif rows and kind < 0.35:
            _, text, lang = rng.choice([r for r in rows if r[1] and r[1].strip()])
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(tongues[lang])
            text = " ".join(words)
        elif kind < 0.42:
            text = rng.choice([None, "", "  ", "12 34 !!"])
        else:
            words = rng.choices(tongues[lang], k=rng.randrange(30, 90))
            if kind < 0.5:
                words[5:5] = items[0 if lang == "bb" else 1][1].split(" ")
            text = " ".join(words)
        rows.append((d, text, lang))
    return rows, items


def by_force(rows, items):
    kept = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    largest = {}
    for d, t in kept:
        largest[lower(t)] = max(d, largest.get(lower(t), -1))
    kept = [(d, t) for d, t in kept if largest[lower(t)] == d]
    parts = components_by_force(kept)
    kept = [(d, t) for d, t in kept if parts[d] == d]
    return [(d, t) for d, t in kept if not any(best_window(t, item) >= 0.8 for _, item in items)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = planted()
    folder = str(tmp_path / "tables")
    spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    plain = bpe.TreeCodec(bpe.read_ranks(RANKS), PATTERN).plain
    want = by_force(rows, items)
    assert 20 < len(want) < 120
    ids = {d: plain.encode_ordinary(t) for d, t in want}
    assert out == {(d, len(ids[d]), hashlib.sha256(" ".join(map(str, ids[d])).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in want}


def test_stages_decide_row_by_row(spark, tmp_path):
    """Null and repeated ids, repeated rows, a very long text and columns with the operators' own names."""
    folder = str(tmp_path / "tables")
    rng = random.Random(22)
    words = [a + b + c + d for a in "kt" for b in "ao" for c in "rn" for d in "eu"]
    item, clean, long = (rng.choices(words, k=n) for n in (30, 80, 40_000))
    near = [*clean]
    near[40] = "edit"
    texts = [
        (None, clean), (7, near), (7, rng.choices(words, k=50)), (None, item + clean[:9]), (7, item), (3, item[:29] + ["end"]), (None, long), (8, long), (9, near), (9, near), (9, ["12", "34"]),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, row_key string, comp long, lang_pred string"
    rows = [(d, " ".join(t), "aa", "s", 1, k, "k", -1, "l") for k, (d, t) in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == [f.split()[0] for f in schema.split(", ")]
        kept.append({r["row"] for r in docs.collect()})
    assert kept[0] == set(range(10))  # the last row has no letters
    # Equal texts: of the long ones the one with an id stays, of the repeated rows one, with the larger id of all three.
    assert {2, 0, 3, 4, 5, 7} < kept[1] and kept[1] - {0, 2, 3, 4, 5, 7} in ({8}, {9})
    # Near copies: the row without an id counts as largest; the two items differ in one shingle of 26.
    assert len(kept[2] & {0, 8, 9}) == 1 and 0 not in kept[2] and {2, 3, 7} < kept[2] and len(kept[2] & {4, 5}) == 1
    assert 2 in kept[3] and 7 in kept[3] and not kept[3] & {3, 4, 5}


def test_pipeline_of_an_empty_table_and_stage_columns(spark, tmp_path):
    folder, schema = str(tmp_path / "tables"), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_language_stage_keeps_texts_of_little_evidence(spark):
    rows, _ = planted()
    texts = [*[(d, t, g) for d, t, g in rows if t and len(t) > 60], (900, "A.", "aa"), (901, "Re.", "bb"), (902, "In. The.", "aa"), (903, "xyzzy qwfpg", "bb"), (904, "12 34", "aa"), (905, None, "bb"), (906, "", "aa")]
    docs = spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {d for d, _, _ in texts} - {904, 905, 906}
