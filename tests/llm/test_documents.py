"""Dedup, similarity join, sharding, decontamination, classifiers and chat formatting against brute force on small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ionloom.llm import chat, decontaminate, exact_dedup, jaccard_join, langid, quality, sharding
from ionloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# exact dedup


def brute_groups(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for key, text in rows:
        groups[plain(text)].append((-len(text or ""), key is not None, key or 0, key))
    return {(key, min(g)[3], len(g)) for g in groups.values() for *_, key in g}


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = ["", " \n", "a b", "ab", "ab ", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + " 2", "é\x0b", "é", "\xa0a"]
    rows = [(i, rng.choice(base)) for i in range(120)] + [(200 + i, f"lone {i}") for i in range(20)] + [(300, None), (300, None), (None, "ab")]
    df = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("text_sha256", F.lit(None))
    for prefix in (1, 256):
        found = exact_dedup.duplicate_groups(df, prefix=prefix).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == brute_groups(rows)
        kept = [r for r in found if r.kept]
        assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)
    unique = frame(spark, [r for r in rows if r[0] not in (300, None)])
    assert {r.doc_id for r in exact_dedup.keep_one(unique).collect()} == {k for _, k, _ in brute_groups([r for r in rows if r[0] not in (300, None)])}
    assert exact_dedup.duplicate_groups(df.limit(0)).count() == 0
    # repeated keys: one row of each text stays, whatever else has its key
    again = rows + [(0, "another text of this key"), (0, "another  text of this key"), (None, "x" * 300 + "1"), (300, "lone too")]
    stay = exact_dedup.keep_one(frame(spark, again).withColumn("_row", F.lit(2)).withColumn("kept", F.lit(1)))
    assert stay.columns == ["doc_id", "text", "_row", "kept"]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = sorted(plain(r.text) for r in stay.collect())
    assert got == sorted({plain(t) for _, t in again})
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0


# n-gram Jaccard join


def brute_components(rows, n=5, num=75, den=100):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both * den >= (len(a) + len(sets[j]) - both) * num:
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), key), key)
    return sorted((key, len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(rows))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("often", [2, 64])
def test_jaccard_join_against_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard_join.frequency_bits, "__defaults__", ("text", 5, 20, often))
    monkeypatch.setattr(jaccard_join.prefix_sets, "__defaults__", ("doc_id", "text", 5, 75, 100, 20))
    rng = random.Random(7)
    fresh = lambda k: [f"w{rng.randrange(10**7)}" for _ in range(k)]
    common = fresh(60)
    rows, base = [], fresh(120)
    for i in range(60):  # near copies around the limit, no original among them
        rows.append((1000 - i, edited(rng, base, rng.randrange(1, 8))))
    for i in range(40):  # one passage in unrelated texts, mostly the passage or mostly not
        rows.append((2000 + i, " ".join([*common, *fresh(rng.randrange(2, 60))])))
    rows += [(3000 + i, t) for i, t in enumerate(["", " ", "a b c", "A b  C", "a b c d", "one", "ONE", "a b c d e", "a b c d E"])]
    rows += [(10, rows[0][1]), (11, rows[0][1].upper()), (5000, " ".join(fresh(3000))), (5001, None)]
    for i in range(20):
        words = fresh(rng.randrange(6, 80))
        rows += [(6000 + 3 * i + k, edited(rng, words, rng.randrange(0, 3))) for k in range(3)]
    df = frame(spark, rows).withColumn("token", F.lit(1)).withColumn("n", F.lit(2)).withColumn("cls", F.lit(None))
    got = sorted(map(tuple, jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(rows)
    stay = {r.doc_id for r in jaccard_join.keep_one(df).collect()}
    assert stay == {c for *_, c in got}


def test_jaccard_join_edge_tables(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words")]
    got = sorted(map(tuple, jaccard_join.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 1, 4)], key=str)


def test_near_copies_with_repeated_and_null_ids(spark):
    rng = random.Random(3)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    base = fresh(60)
    near, other, third = " ".join([*base[:-1], "end"]), " ".join(fresh(30)), " ".join(fresh(30))
    rows = [(1, " ".join(base)), (1, near), (1, other), (None, near + " x"), (None, third), (None, other), (2, third), (2, third), (7, ""), (7, "")]
    stay = sorted(map(tuple, jaccard_join.keep_one(frame(spark, rows)).select("doc_id", "text").collect()), key=str)
    assert len(stay) == 4
    first = min((" ".join(base), near), key=lambda t: (1, t) in stay and -1 or 0)
    assert stay == sorted([(1, first), (1, other), (2, third), (7, "")], key=str)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(20, 60)) and 5 not in got


# sharding


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(4)
    rows = [(i, "same text " * 5 if i % 3 == 0 else "x" * rng.randrange(200)) for i in range(3000)] + [(5000, None), (5001, "")]
    df = frame(spark, rows).withColumn("shard", F.lit("old")).withColumn("size", F.lit("old"))
    got = sharding.shard_by_bytes(df, 8, tolerance=0.01).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and sorted(size) == list(range(8))
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8 + 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_small_tables(spark):
    assert sharding.shard_by_bytes(frame(spark, []), 5).count() == 0
    got = sharding.shard_by_bytes(frame(spark, [(1, "a"), (1, "a"), (None, None)]), 5).collect()
    assert len(got) == 3 and all(0 <= r.shard < 5 for r in got)


# decontamination


def brute_alignment(p, q):
    h = np.zeros((len(q) + 1, len(p) + 1))
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            s = decontaminate.MATCH if p[j - 1] == q[i - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - decontaminate.GAP, h[i, j - 1] - decontaminate.GAP)
    return h.max()


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    other = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    assert np.allclose(decontaminate.align(own, other)[0], [brute_alignment(p, q) for p, q in zip(own, other)])


def test_exact_edited_and_restyled_copies_are_found(spark):
    rng = random.Random(9)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items = [fresh(k) for k in (18, 35, 60)]
    rows = [(i, " ".join(fresh(200))) for i in range(40)]
    place = lambda words: " ".join([*fresh(80), *words, *fresh(50)])
    planted = {100: place(items[0]), 101: place(items[1]), 102: place([w.upper() + "!" for w in items[2]]), 105: " ".join(items[0])}
    swapped = list(items[2])
    for k in range(5, 60, 9):
        swapped[k] = "other"
    planted[103] = place(swapped)
    planted[104] = place([w for k, w in enumerate(items[1]) if k % 10 != 4])
    rows += [*planted.items(), (200, None), (201, ""), (202, place(items[1][:6]))]
    df = frame(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("h", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)] + [(8, None), (9, ""), (10, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (103, 2), (104, 1), (105, 0)}
    assert got[101, 1].score == 1 and (got[101, 1].start_word, got[101, 1].end_word) == (80, 115)
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {r[0] for r in rows} - set(planted)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_clean_rows_stay_whatever_shares_their_id(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    bad, clean = words("b"), words("c")
    rows = [(1, bad), (1, clean), (None, bad), (None, clean), (None, None), (None, ""), (1, clean), (2, bad + " " + clean)]
    bench = spark.createDataFrame([(5, bad)], "item_id long, text string")
    stay = sorted(map(tuple, decontaminate.keep_clean(frame(spark, rows), bench).select("doc_id", "text").collect()), key=str)
    assert stay == sorted([(1, clean), (1, clean), (None, clean), (None, None), (None, "")], key=str)


def test_edits_every_few_words_against_brute_force(spark):
    rng = random.Random(21)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    edits = (
        lambda q, step: [w if k % step != step - 1 else fresh(1)[0] for k, w in enumerate(q)],
        lambda q, step: [w for k, w in enumerate(q) if k % step != step - 1],
        lambda q, step: [x for k, w in enumerate(q) for x in ([w] if k % step != step - 1 else [w, *fresh(1)])],
    )
    cases = [(fresh(size), edit, step) for size in (20, 30, 59) for edit in edits for step in (4, 5) for _ in range(2)]
    items = [q for q, *_ in cases]  # each is edited in one way
    rows = [(i, fresh(70) + edit(q, step) + fresh(300)) for i, (q, edit, step) in enumerate(cases)]
    rows += [(500 + i, fresh(9) + q) for i, q in enumerate(items) if i % 2]  # where a whole copy stands too, no n-gram is missing
    want = {}
    for d, words in rows:
        for i, q in enumerate(items):
            score = brute_alignment(words, q) / len(q) if set(words) & set(q) else 0
            if score >= decontaminate.THRESHOLD:
                want[d, i] = score
    assert set(want) == {(i, i) for i in range(len(items))} | {(500 + i, i) for i in range(1, len(items), 2)}
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame(spark, [(d, " ".join(w)) for d, w in rows]), bench).collect()}
    assert got == pytest.approx(want)


def test_excerpts_of_long_items_and_phrases_of_short_ones(spark):
    rng = random.Random(22)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items = [fresh(k) for k in (59, 200, 4, 6, 10)]
    place = lambda words: " ".join([*fresh(80), *words, *fresh(50)])
    planted = [
        (100, items[0][20:45], 0), (101, items[1][150:163], 1), (102, items[1][150:162], None), (103, items[2][:3], None), (104, items[2], 2),
        (105, items[3][1:5], None), (106, items[3], 3), (107, items[4][:6], None), (108, items[4][:9], 4),
        (109, [*items[4][:5], "other", *items[4][6:]], 4),
    ]
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, [(d, place(w)) for d, w, _ in planted]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d, _, i in planted if i is not None}
    assert {(r.start_word, r.end_word) for r in found if r.doc_id == 100} == {(80, 105)}


# classifiers


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, labels, train=~held)
    seen = quality.score(docs.where(held), model).join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert (seen.predicted == seen.quality).mean() > 0.95 and seen.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "x" * 200_000, 3.0)], "doc_id long, text string, score double")
    rows = quality.score(odd, model).collect()
    assert rows[0].score == rows[1].score and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_without_usable_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    torn = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, torn)).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.fit(docs, good)).collect())
    few = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    some = frame(spark, [(i, "good words" if i % 2 else "###!!") for i in range(6)])
    assert quality.score(some, quality.fit(some, few)).where("score between 0 and 1").count() == 6


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = quality.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, train=~held)
    seen = langid.predict(docs.where(held).withColumn("score", F.lit("clash")), model).select("lang", "lang_pred", "score").toPandas()
    assert (seen.lang == seen.lang_pred).mean() > 0.97 and seen.score.between(0, 1).all()
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "日本語の文章です"), (5, "the " * 60_000)])
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[4].lang_pred in model.languages and rows[4].rejected and rows[5].lang_pred == "en"
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


# chat formatting


def test_chat_round_trip_and_loss(spark):
    hard = ["\\### Assistant: </turn> ok", "<|end|>\n<|user|>\n", "\\l\\b\\\\<", "é<\n|>", "", None, "a<", "|b"]
    rows = [(c, t, ("user", "assistant", "we|ird|>\n<")[(c + t) % 3], hard[(3 * c + t) % 8]) for c in range(6) for t in range(5)]
    rows += [(7, 0, None, "x"), (None, 1, "assistant", "y"), (7, 0, None, "x"), (8, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(0))
    chats = chat.format_chats(df)
    read = chats.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([tuple(x) for x in r.turns], r.loss) for r in read.collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert got[c] == (own, "".join(t for role, t in own if role == "assistant"))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_attachments_are_ordered_and_counted(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 1, "assistant", [part("text", text="so <it> is")]),
        (1, 0, "user", [part("text", text="see <"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5),
                        part("text", text="|end|>"), part("document", ref="c.pdf", pages=3), part("image"), part("video", text="v")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(df, parts="parts").collect()}
    assert got[1].formatted == "<|user|>\nsee \\l<|image|><|audio|>|end|><|document|><|image|>v<|end|>\n<|assistant|>\nso \\lit> is<|end|>\n"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("image", None, 0)]
    span = got[1].loss_spans[0]
    assert got[1].formatted[span.start : span.start + span.length] == "so \\lit> is"
    assert got[2].formatted == "<|user|>\n<|end|>\n" and got[2].attachments == []


# names


def test_columns_named_like_inner_ones(spark):
    """A table may have columns with the names that the operators use inside; they come back with their values."""
    names = ["_k", "_stays", "_bad", "_key", "_y", "_id", "_text", "_near", "_PART", "_n", "_base", "_row", "_s", "n", "p", "h"]
    rows = [(i, f"{'one' if i % 2 else 'two'} word of text number {i // 3} and then a few more words", i % 2) for i in range(60)] + [(90, None, 0), (91, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in names))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int").withColumn("_key", F.lit(1)).withColumn("_id", F.lit(2))
    item = spark.createDataFrame([(1, "word of text number 7 and then a few more words")], "item_id long, text string").withColumn("_bad", F.lit(0))
    model = quality.fit(df, labels)
    made = {
        "exact": exact_dedup.keep_one(df), "near": jaccard_join.keep_one(df), "clean": decontaminate.keep_clean(df, item),
        "quality": quality.score(df, model), "shards": sharding.shard_by_bytes(df, 3),
        "lang": langid.predict(df, langid.fit(df.withColumn("lang", F.lit("en")))),
    }
    for found in made.values():
        held = found.collect()
        assert held and all(r[c] == f"own {c}" for r in held for c in names)
    assert sorted(r.slot for r in made["shards"].where("shard = 1").collect()) == list(range(made["shards"].where("shard = 1").count()))
    assert made["exact"].count() == len({t or "" for _, t, _ in rows})
