"""BPE, token counts and token files against the public libraries and exact round trips."""

import gc
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import bpe, token_count, token_files
from ionloom.llm import textbatch as tb
from ionloom.llm.queries import tokenizer
from ionloom.session import scratch_folder

TRICKY = [
    "", "a", "'s", "it's 'll we're  x'd''s \n\n  hi\t 's", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|><|endoftext|>z  ",
    "  ", " \n", "日本語テキスト ½ ①②  é 　x", "a" * 500, "=====" * 100, "\x00a\x00 \x1c b\x85c", "😀😀 👩‍👩‍👧", "''", "'R", "don't've",
]


def noise(letters, n, most=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.read_vocabulary(tokenizer("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_bpe_equals_the_library(vocabulary, library):
    texts = TRICKY + noise("ab 's'lrevetdm\n\t1.é  日! ", 600) + noise("thereandingtion", 300, 90)
    offsets, ids = vocabulary.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert vocabulary.decode(offsets, ids).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_proposals_that_pass_need_no_merging_and_failing_words_are_merged(vocabulary):
    words = [w.encode() for w in ("the", "hello", "xqzt", "thereinto", "zzzzzzzz" * 20)]
    packed = vocabulary.encode_words(pa.array(words, pa.binary()))
    assert [np.frombuffer(p, np.int32).tolist() for p in packed] == [vocabulary.merge(w) for w in words]


def test_common_words_are_encoded_once_while_rare_ones_are_forgotten(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100_000)
    seen = []
    propose = vocabulary.propose

    def watched(data, offsets):
        seen.extend(data[a:b].tobytes() for a, b in zip(offsets, offsets[1:]))
        return propose(data, offsets)

    monkeypatch.setattr(vocabulary, "propose", watched)
    common = [f" qx{a}{b}zv" for a in "abcdefghijklmn" for b in "abcdefghijklmn"]
    letters = [chr(97 + i) for i in range(20)]
    for k in range(20):
        texts = ["".join(common) * 2, " ".join(f"wk{letters[k]}{a}{b}" for a in letters for b in letters)]
        offsets, ids = vocabulary.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert max(seen.count(w.encode()) for w in common) == 1
    assert vocabulary.memory.nbytes() < 150_000


def test_words_of_one_hash_and_wide_spaces(vocabulary, library, monkeypatch):
    monkeypatch.setattr(tb, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    monkeypatch.setattr(vocabulary, "memory", bpe.WordMemory())
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 5)
    texts = TRICKY + noise("ab \u3000\u00a0\u0085\u2003\n'sé日9½😀", 300) + ["\u3000x", "a\u00a0\u00a0b", "\u2003 \u2003z \u3000", "\u0085'll"]
    for _ in range(2):  # the second time the memory holds words of the same hash and length
        offsets, ids = vocabulary.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_decode_bytes_that_are_no_text_and_unknown_ids(vocabulary, library):
    half = library.encode("日", add_special_tokens=False).ids[:1]
    text = vocabulary.decode(np.array([0, 1, 3]), np.array([*half, -5, 10**6]))
    assert text.to_pylist() == [library.decode(half, skip_special_tokens=False), ""]


def test_bpe_columns_nulls_and_clashing_names(spark):
    rows = [(1, None, 7, "x"), (2, "", 8, "y"), (2, "hi there", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string")
    done = bpe.decode(bpe.encode(df, tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json"))
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    got = {(r.doc_id, r.text): (list(r.ids), r.decoded) for r in done.collect()}
    assert got[1, None] == ([], "") and got[2, ""] == ([], "") and got[2, "hi there"][1] == "hi there"
    assert bpe.round_trip(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_counts_equal_the_library(monkeypatch):
    import sentencepiece

    with open(tokenizer("piece_bpe_32k.model"), "rb") as file:
        machine = token_count.Transducer(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    texts = TRICKY + noise("ab  the s'lrevetdm\n\t1.é  日! <s></s>▁", 600) + [" " * k + w for k in range(20) for w in ("", "a", "日本", "x y")]
    texts += ["the" * 900, "a b " * 700, "日本語" * 400, "<unk> <s> <0x0A>", "x" * 2000]
    want = [len(x) for x in library.encode(texts)]
    assert machine.counts(pa.array(texts)).tolist() == want
    for size in (7, 64):  # many chunks per text, cut anywhere
        monkeypatch.setattr(token_count, "CHUNK_BYTES", size)
        assert machine.counts(pa.array(texts)).tolist() == want


def test_state_maps_compose_associatively():
    with open(tokenizer("piece_bpe_32k.model"), "rb") as file:
        machine = token_count.Transducer(file.read())
    space = token_count.SPACE
    texts = [space + "the", "rein", "g" + space + "dog", "", "ähnlich"]
    entries = [machine.states[machine.run(machine.START, t)[1]] for t in ("", space + "th", "qu", "é")]
    of = lambda t: token_count.ChunkMap(machine, t)
    for a, b, c in zip(texts, texts[1:], texts[2:]):
        left = token_count.Composed(token_count.Composed(of(a), of(b)), of(c))
        right = token_count.Composed(of(a), token_count.Composed(of(b), of(c)))
        for entry in entries:
            count, state = machine.run(machine._state(entry), a + b + c)
            assert left(entry) == right(entry) == machine.up_sweep([of(a), of(b), of(c)])(entry) == (count, machine.states[state])


def test_token_counts_of_long_texts_without_spaces(monkeypatch):
    import sentencepiece

    rng = random.Random(4)
    path = tokenizer("piece_bpe_32k.model")
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    texts = [letters, "漢字かな交じり文" * 9000, "x" * 70_000 + " " * 70_000 + letters[:500], "é" * 40_000]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [len(x) for x in library.encode(texts)]
    with open(path, "rb") as file:
        machine = token_count.Transducer(file.read())
    read = []
    run = machine.run
    monkeypatch.setattr(machine, "run", lambda state, text: (read.append(len(text)), run(state, text))[1])
    assert machine.counts(pa.array(texts)).tolist() == want
    assert sum(read) < 2 * sum(map(len, texts))  # a chunk once for its entry, its last segment once more for the exit
    monkeypatch.setattr(token_count, "MOST_STATES", 500)  # forgetting on the way changes nothing
    monkeypatch.setattr(token_count, "SEGMENT_MEMORY", 1000)
    machine.forget()
    machine.segments = {}
    assert machine.counts(pa.array(texts)).tolist() == want and len(machine.states) <= 510


def test_token_count_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é x"), (3, "é x")], "n_tokens long, text string")
    rows = token_count.count_tokens(df, tokenizer("piece_bpe_32k.model"), limit=1).collect()
    assert [(r.n_bytes, r.over_limit) for r in rows] == [(0, False), (0, False), (4, True), (4, True)]
    assert [r.n_tokens for r in rows][:2] == [0, 0]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, token_files.BLOCK_IDS, token_files.BLOCK_IDS + 3):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        payload, ends = token_files.pack(ids, bits)
        assert (token_files.unpack(payload, ends, n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_keep_order_and_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 50)
    rng = random.Random(5)
    rows = [(i % 90, [rng.randint(0, 60000) for _ in range(rng.randint(0, 40))]) for i in range(200)] + [(95, None), (None, [5])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(5)
    folder = scratch_folder(spark, "test-token-files")
    token_files.write(token_files.in_order(df, "doc_id", "ids"), folder, bits=bits)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or []))
    at, want = 0, []
    for key, ids in order:
        own = [*(ids or []), 0]
        want.append((key, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    key = lambda r: r[1]
    got = token_files.read(spark, folder, raw=True).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert sorted(map(tuple, got.collect()), key=key) == want
    lists = sorted(token_files.read(spark, folder).collect(), key=key)
    assert [list(r.ids) for r in lists] == [[*(ids or []), 0] for _, ids in order]


def test_empty_token_files(spark):
    df = spark.createDataFrame([], "doc_id long, text string, start string")
    folder = token_files.store(df, tokenizer("byte_bpe_50k.json"))
    assert token_files.read(spark, folder).count() == 0


def test_a_worker_keeps_what_one_step_needs():
    spec = bpe.read_vocabulary(tokenizer("byte_bpe_50k.json")) + " "  # not the one the fixture holds
    held = weakref.ref(bpe.vocabulary(spec))
    assert bpe.vocabulary(spec) is held()  # built once while the step goes on
    assert list(tb.lean(iter([1, 2]))) == [1, 2]
    gc.collect()
    assert held() is None  # the next step does not carry it along
